"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` tokenises each whole text once and stores, per segment of the corpus
and per word, the ascending positions of the word (as differences). A segment is
what one task read until it held ``segment_words`` words, so all postings of a
document are in one segment, and gaps between documents keep phrases apart.

``search`` sends each window of test words to the segments that hold its rarest
word and nowhere else. There the positions of its words, each moved back by the
word's offset in the window, are intersected from the rarest list on: what is left
are the exact occurrences. The same lists, taken with a tolerance, give proximity
matches. No window table is broadcast, and no text is read after indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.llm.common import bounded, documents_of, released, small_batches
from fourthtick.sources.storage import stage

WINDOW_WORDS = 10
SEGMENT_WORDS = 1_500_000
#: How far from its place in a window a word may be in a proximity match.
SLOP = 2

# A segment has one row per word (word, postings) and one per document (doc, base,
# n_words). ``doc`` numbers the rows of documents within the segment.
INDEX = "segment long, word binary, n long, gaps array<int>, doc_id long, base int, n_words int"

# Words are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z have a lower case.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _segment_rows(segment: int, ids: list, sizes: list, words: dict, stream: list, gap: int):
    """The rows of one segment as a record batch."""
    n_words = np.array(sizes, dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(n_words + gap)[:-1]]) if len(sizes) else n_words
    code = np.concatenate(stream) if stream else np.empty(0, np.int32)
    stream.clear()
    found = np.bincount(code, minlength=len(words))
    # One sort, in place, of (word, position) pairs packed into 64 bits.
    packed = code.astype(np.int64)
    del code
    packed <<= 32
    packed |= np.arange(len(packed)) + np.repeat(np.arange(len(sizes)) * gap, n_words)
    packed.sort()
    place = packed.astype(np.uint32).view(np.int32)  # the low half
    del packed
    bounds = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
    gaps = np.diff(place, prepend=np.int32(0))
    gaps[bounds[:-1]] = place[bounds[:-1]]  # every list starts with a position
    docs, terms = len(ids), len(words)
    none = pa.nulls
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(docs + terms, segment)),
            pa.concat_arrays([pa.array(list(words), pa.binary()), none(docs, pa.binary())]),
            pa.concat_arrays([pa.array(found), none(docs, pa.int64())]),
            pa.concat_arrays(
                [pa.ListArray.from_arrays(bounds, pa.array(gaps)), none(docs, pa.list_(pa.int32()))]
            ),
            pa.concat_arrays([none(terms, pa.int64()), pa.array(ids, pa.int64())]),
            pa.concat_arrays([none(terms, pa.int32()), pa.array(base.astype(np.int32))]),
            pa.concat_arrays([none(terms, pa.int32()), pa.array(n_words.astype(np.int32))]),
        ],
        names=["segment", "word", "n", "gaps", "doc_id", "base", "n_words"],
    )


def build_index(
    docs: DataFrame, segment_words: int = SEGMENT_WORDS, gap: int = WINDOW_WORDS
) -> DataFrame:
    """The stored positional index of doc_id and text; null text has no words."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counter((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        ids, sizes, words, stream, held = [], [], {}, [], 0
        for batch in released(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and held + gap * len(ids) >= segment_words:
                    yield _segment_rows(next(number), ids, sizes, words, stream, gap)
                    ids, sizes, words, stream, held = [], [], {}, [], 0
                found = words_of(text.as_py())
                codes = [words.setdefault(w, len(words)) for w in found]
                ids.append(doc_id)
                sizes.append(len(codes))
                stream.append(np.array(codes, dtype=np.int32))
                held += len(codes)
        if ids:
            yield _segment_rows(next(number), ids, sizes, words, stream, gap)

    return stage(documents_of(docs, "doc_id", "text").mapInArrow(index, INDEX), "index")


def windows_of(items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """item_id and words of every window of ``length`` words; a shorter item is one window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for at in range(max(1, len(words) - length + 1) if words else 0):
                    ids.append(item)
                    out.append(words[at : at + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.binary()))],
                names=["item_id", "words"],
            )

    return documents_of(items, "item_id", "text").mapInArrow(
        windows, "item_id long, words array<binary>"
    )


def phrase_positions(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts of a phrase, from (offset in the phrase, ascending positions) of its words."""
    starts = None
    for offset, positions in sorted(lists, key=lambda x: len(x[1])):
        moved = positions - offset
        if starts is None:
            starts = moved
        else:
            at = np.minimum(np.searchsorted(moved, starts), len(moved) - 1)
            starts = starts[moved[at] == starts]
        if not len(starts):
            break
    return starts


def near_positions(
    lists: list[tuple[int, np.ndarray]], first: int, slop: int
) -> np.ndarray:
    """Positions of the window's word number ``first`` that have every other word at most
    ``slop`` away from where the phrase would have it."""
    anchors = lists[first][1]
    for offset, positions in sorted(lists, key=lambda x: len(x[1])):
        wanted = anchors + (offset - first)
        after = np.searchsorted(positions, wanted - slop)
        reached = positions[np.minimum(after, len(positions) - 1)]
        anchors = anchors[(after < len(positions)) & (reached <= wanted + slop)]
        if not len(anchors):
            break
    return anchors


RESULT = (
    "doc_id long, n_words long, n_hit long, items array<long>, near_items array<long>, "
    "unnamed_items boolean"
)


def _search_segment(slop: int | None):
    def search(rows: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        is_doc = rows["is_doc"]
        docs = rows[is_doc].sort_values("base", kind="stable")
        base = docs["base"].to_numpy(np.int64)
        n_words = docs["n_words"].to_numpy(np.int64)
        postings = {
            word: np.cumsum(gaps, dtype=np.int64)
            for word, gaps in zip(rows["word"][~is_doc], rows["gaps"][~is_doc], strict=True)
        }
        size = int(base[-1] + n_words[-1]) + 1 if len(docs) else 0
        hit = np.zeros(size + 1, dtype=np.int64)
        exact: dict[int, set] = {}
        near: dict[int, set] = {}

        def note(where: dict[int, set], positions: np.ndarray, item) -> None:
            for d in np.unique(np.searchsorted(base, positions, side="right") - 1).tolist():
                where.setdefault(d, set()).add(item)

        for item, words, rarest in zip(
            windows["item_id"], windows["words"], windows["rarest"], strict=True
        ):
            item = None if item is None else int(item)
            lists = [(i, postings.get(w)) for i, w in enumerate(words)]
            if any(p is None for _, p in lists):
                continue
            starts = phrase_positions(lists)
            if len(starts):
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + len(words), -1)
                note(exact, starts, item)
            if slop is not None:
                first = next(i for i, w in enumerate(words) if w == rarest)
                if len(anchors := near_positions(lists, first, slop)):
                    note(near, anchors, item)
        # Words covered up to each position; documents end before their gap.
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
        n_hit = covered[base + n_words] - covered[base]

        def named(where: dict[int, set]) -> list[list[int]]:
            return [sorted(i for i in where.get(d, ()) if i is not None) for d in range(len(docs))]

        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].astype("Int64").mask(docs["unnamed"]).array,
                "n_words": n_words,
                "n_hit": n_hit,
                "items": named(exact),
                "near_items": named(near),
                "unnamed_items": [None in exact.get(d, ()) for d in range(len(docs))],
            }
        )

    return search


def search(index: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Every indexed document with n_words, n_hit, and the items matched exactly and nearly.

    n_hit counts the words inside any occurrence of a window. ``near_items`` stays
    empty unless ``slop`` is given. An item without an id hits words but is in no
    list; ``unnamed_items`` tells where that happened.
    """
    terms = index.where("word IS NOT NULL")
    # Staged, so that its size is known when the join with the whole index is planned.
    wanted = stage(windows.select(F.explode("words").alias("word")).distinct(), "test-words")
    frequency = (
        terms.select("word", "n").join(wanted, "word").groupBy("word").agg(F.sum("n").alias("df"))
    )
    # The rarest word of each window; a window with a word that never occurs has no match.
    windows = stage(windows.distinct().withColumn("_w", F.xxhash64("item_id", "words")), "windows")
    ranked = (
        windows.select("_w", "words", F.explode(F.array_distinct("words")).alias("word"))
        .join(frequency, "word")
        .groupBy("_w", "words")
        .agg(
            F.count(F.lit(1)).alias("_present"),
            F.min_by("word", F.struct("df", "word")).alias("rarest"),
        )
        .where(F.col("_present") == F.size(F.array_distinct("words")))
        .select("words", "rarest")
        .distinct()
    )
    windows = stage(
        windows.join(ranked, "words").select("item_id", "words", "rarest"), "live-windows"
    )
    routed = stage(
        terms.select("segment", F.col("word").alias("rarest"))
        .join(windows, "rarest")
        .select("segment", F.col("item_id").cast("string").alias("item_id"), "words", "rarest"),
        "routed",
    )
    needed = stage(windows.select(F.explode("words").alias("word")).distinct(), "live-words")
    # No nulls among the numbers: pandas would turn them into floats and lose large ids.
    columns = [
        "segment",
        "word",
        "gaps",
        F.col("word").isNull().alias("is_doc"),
        (F.col("word").isNull() & F.col("doc_id").isNull()).alias("unnamed"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("doc_id", "base", "n_words")],
    ]
    lists = (
        terms.join(needed, "word", "left_semi")
        .select(*columns)
        .unionByName(index.where("word IS NULL").select(*columns))
    )
    return (
        lists.groupBy("segment")
        .cogroup(routed.groupBy("segment"))
        .applyInPandas(_search_segment(slop), RESULT)
    )


def items_digest(items: str | Column) -> Column:
    """sha256 of the item ids sorted as strings and joined by commas."""
    items = F.col(items) if isinstance(items, str) else items
    texts = F.array_sort(F.transform(items, lambda i: i.cast("string")))
    return F.sha2(F.array_join(texts, ",").cast("binary"), 256)


def find_contamination(
    docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS, slop: int | None = None
) -> DataFrame:
    """Every document with the test items of which a window occurs in it.

    Documents need doc_id and text, items item_id and text. Null or wordless texts
    have no words and no windows. Repeated documents are each reported; repeated
    items count once. Without items nothing is contaminated; without documents the
    result is empty. Other columns are not read.
    """
    # Words of two documents are further apart than any two words of a match may be.
    gap = length + 2 * (slop or 0)
    return search(build_index(docs, gap=gap), windows_of(items, length), slop)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """The documents, with their own columns, in which no test window occurs.

    Null and wordless texts stay, repeated rows are each judged, and an empty table of
    documents or of items takes nothing away.
    """
    key = F.xxhash64("doc_id", "text")
    with small_batches(docs.sparkSession):
        found = find_contamination(docs.select(key.alias("doc_id"), "text"), items, length)
        hit = stage(found.where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct(), "hit")
    # The caller's columns travel as one, so that none of them can clash with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(key.alias("key"), row).join(bounded(hit), F.col("key") == F.col("hit"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
