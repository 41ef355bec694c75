"""Ranked lexical search in which documents with equal bags of query terms are scored once.

A document is restricted to the vocabulary of the items: what is left of it is a bag of
(term, occurrences) and a length factor. Documents equal in both form a class: they are
dealt by a hash and told apart by the bag itself. Terms are weighted and classes scored
without looking at their members, and only the classes that reach an item's list are
expanded, by ascending doc_id.

Items are taken in blocks of bounded size, so what is sent to every task is bounded
however many items there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.llm.common import bounded
from fourthtick.sources.storage import stage

TOP = 50
#: (item, term) pairs of one block of items, on average.
BLOCK_PAIRS = 500_000
#: Weight of the length against the mean, in hundredths, and the saturation of repeats.
LENGTH_SHARE = 50
SATURATION = 20

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The same terms in bytes: ASCII letters folded, other ASCII but digits separates.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_PIECE = 1 << 20
# Bounds of one scoring step inside a task.
_PAIRS, _CELLS, _HELD = 2_000_000, 4_000_000, 500_000


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, a long text piece by piece."""
    folded = text.translate(_FOLD)
    start = 0
    while len(folded) - start > _PIECE:
        end = folded.find(b" ", start + _PIECE)
        if end < 0:
            break
        yield folded[start:end].split()
        start = end
    yield folded[start:].split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each; rows that repeat an item_id add to the same item."""
    terms = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(terms)).alias("term")).distinct()


def bags_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text) and bag: (term number, occurrences) by term number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for terms in term_lists(text.as_py() or b""):
                    n += len(terms)
                    found.update(t for t in terms if t in number)
                sizes.append(n)
                pairs = sorted((number[t], k) for t, k in found.items())
                bags.append(np.array(pairs, dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                names=["doc_id", "n", "bag"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(restrict, "doc_id long, n long, bag binary")


def classes_of(bags: DataFrame, documents: int, terms: int) -> DataFrame:
    """Bags with their length factor m and a hash of both; documents without a query term are left out."""
    mean_share = (F.lit(LENGTH_SHARE) * F.col("n") * F.lit(documents)).cast("long")
    m = F.lit(100 - LENGTH_SHARE) + F.call_function("div", mean_share, F.lit(max(terms, 1)))
    rows = bags.where(F.octet_length("bag") > 0).withColumn("m", m.cast("long"))
    return rows.withColumn("h", F.xxhash64("m", "bag"))


def _pairs_of(bags: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each bag, and all (term, occurrences) one after the other."""
    bounds = np.frombuffer(bags.buffers()[1], "<i4")[bags.offset : bags.offset + len(bags) + 1]
    held = bags.buffers()[2]
    flat = np.frombuffer(held, "<i4", count=int(bounds[-1]) // 4) if held else np.empty(0, "<i4")
    return np.diff(bounds) // 8, flat[bounds[0] // 4 :].reshape(-1, 2).astype(np.int64)


def document_frequencies(classes: DataFrame, n_terms: int) -> np.ndarray:
    """For each term number, the documents that hold it: sizes of the classes that do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            entries, pairs = _pairs_of(batch.column(0))
            np.add.at(df, pairs[:, 0], np.repeat(batch.column(1).to_numpy(), entries))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    parts = classes.select("bag", "size").mapInArrow(count, "term long, df long")
    # At most one row per term of the block.
    found = parts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def weights_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(k) + 1))) for k in df], np.int64
    )


def _best(kept: list[np.ndarray], top: int) -> list[np.ndarray]:
    """The ``top`` entries (item, score, first, class) of each item, by score and first document."""
    item, score, first, _ = kept
    order = np.lexsort((first, -score, item))
    kept = [a[order] for a in kept]
    at = np.arange(len(order))
    starts = np.flatnonzero(np.diff(kept[0], prepend=-1))
    rank = at - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return [a[rank < top] for a in kept]


def best_classes(
    classes: DataFrame, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, top: int
) -> DataFrame:
    """(item, score, first, class_id): what each task finds best for each item.

    ``items[starts[t]:starts[t + 1]]`` are the items that hold term t. A class that is
    in no task's list for an item has ``top`` better classes in its own task.
    """
    sent = classes.sparkSession.sparkContext.broadcast((weights, starts, items))
    none = np.iinfo(np.int64).max

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item_of = sent.value
        degree = np.diff(start)
        least = np.ones(n_items, np.int64)
        kept = [np.empty(0, np.int64) for _ in range(4)]
        waiting, n_waiting = [], 0

        def settle() -> None:
            nonlocal kept, waiting, n_waiting
            kept = _best([np.concatenate(a) for a in zip(kept, *waiting)], top)
            waiting, n_waiting = [], 0
            # An item with a full list takes only what reaches the last of it.
            n = np.bincount(kept[0], minlength=n_items)
            full = n >= top
            least[full] = kept[1][np.cumsum(n)[full] - 1]

        for batch in batches:
            entries, pairs = _pairs_of(batch.column("bag"))
            m = batch.column("m").to_numpy()
            ids = batch.column("class_id").to_numpy()
            first = batch.column("first").fill_null(none).to_numpy()
            ends = np.cumsum(entries)
            work = np.cumsum(degree[pairs[:, 0]])[ends - 1] if len(ids) else ends
            lo = 0
            while lo < len(ids):
                done = work[lo - 1] if lo else 0
                hi = int(np.searchsorted(work, done + _PAIRS, "right"))
                hi = max(lo + 1, min(hi, lo + max(1, _CELLS // n_items), len(ids)))
                part = pairs[ends[lo] - entries[lo] : ends[hi - 1]]
                term, tf = part[:, 0], part[:, 1]
                of = np.repeat(np.arange(hi - lo), entries[lo:hi])
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[lo:hi][of]))
                times = degree[term]
                # Every (class, term) once for each item that holds the term.
                skip = np.repeat(np.cumsum(times) - times, times)
                place = np.arange(len(skip)) - skip + np.repeat(start[term], times)
                total = np.zeros((hi - lo) * n_items, np.int64)
                np.add.at(total, np.repeat(of, times) * n_items + item_of[place], np.repeat(value, times))
                total = total.reshape(-1, n_items)
                which, item = np.nonzero(total >= least)
                waiting.append([item, total[which, item], first[lo:hi][which], ids[lo:hi][which]])
                n_waiting += len(item)
                if n_waiting > _HELD:
                    settle()
                lo = hi
        settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in kept], names=["item", "score", "first", "class_id"]
        )

    return classes.select("m", "bag", "first", "class_id").mapInArrow(
        score, "item long, score long, first long, class_id long"
    )


def _ranked(rows: DataFrame, group: str, top: int, *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0.

    docs: doc_id (integer), text. items: item_id, text; other columns are not read. Null and
    empty texts have no terms. Items without a term, or whose terms no document holds, have
    no rows; rows with the same item_id (null too) make one item. Repeated documents are each
    ranked; a null doc_id comes after all others of its score. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    pairs = stage(item_terms(items), "item-terms")
    names = stage(
        pairs.select("item_id").distinct().withColumn("number", F.monotonically_increasing_id()),
        "item-numbers",
    )
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    counts = None
    results = []
    for block in range(blocks):
        chosen = names.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        held = chosen.join(pairs, chosen["item_id"].eqNullSafe(pairs["item_id"]))
        local = held.select("number", F.col("term").cast("binary").alias("term")).toArrow()
        number, item = np.unique(local["number"].to_numpy(), return_inverse=True)
        terms = sorted(set(local["term"].to_pylist()))
        if not terms and counts:
            continue
        vocabulary = {t: i for i, t in enumerate(terms)}
        bags = stage(bags_of(docs, vocabulary), "bags")
        if counts is None:
            counts = bags.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        documents, length = counts[0], counts[1] or 0
        if not terms or not documents:
            continue
        rows = classes_of(bags, documents, length)
        classes = rows.groupBy("h", "m", "bag").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("size")
        )
        classes = stage(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
        term = np.array([vocabulary[t] for t in local["term"].to_pylist()], np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        weights = weights_of(document_frequencies(classes, len(terms)), documents)
        found = best_classes(classes, weights, starts, item[order], len(number), top)
        best = _ranked(found, "item", top, F.desc("score"), F.asc("first")).drop("rank", "first")
        best = stage(best, "best-classes")

        # Members of the classes in a list: found by hash, then by the bag itself.
        listed = stage(
            classes.join(bounded(best.select("class_id").distinct()), "class_id").select(
                "class_id", "h", "m", "bag"
            ),
            "listed",
        )
        near = rows.join(bounded(listed.select("h").distinct()), "h", "left_semi")
        members = near.join(listed, ["h", "m", "bag"]).select("class_id", "doc_id")
        members = _ranked(members, "class_id", top, F.asc_nulls_last("doc_id")).drop("rank")
        ranked = _ranked(
            best.join(members, "class_id"), "item", top, F.desc("score"), F.asc_nulls_last("doc_id")
        )
        # Numbers of this block's items, at most ``block_pairs`` of them on average.
        back = spark.createDataFrame(
            pa.table({"item": np.arange(len(number)), "number": number})
        )
        results.append(
            ranked.join(back, "item").join(names, "number").select("item_id", "rank", "doc_id", "score")
        )
    if not results:
        empty = items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"))
        return empty.withColumn("score", F.lit(0).cast("long")).limit(0)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
