"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its
size follows the document and sketches of very unequal documents stay comparable:
the share of a small sketch found in a large one estimates containment. Sketches of
parts merge into the sketch of the whole. A text with shingles none of which falls
below the threshold keeps its smallest hash, so only texts without words have an
empty sketch; ``merge`` and the estimates allow for that.

Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.llm.common import documents_of

SHINGLE_WORDS = 5
SCALE = 4
ROWS_PER_BUCKET = 4000
MOST_BUCKETS = 4095


def with_sketch(
    rows: DataFrame, text: str, into: str, k: int = SHINGLE_WORDS, scale: int = SCALE
) -> DataFrame:
    """Adds the sketch of column ``text``: ascending distinct 64-bit hashes.

    Words are runs without white space in lower case; a text of fewer than ``k``
    words, but not none, is one shingle. Hashes lie between 0 and 2**63, and those
    below 2**63 / ``scale`` are kept. Null counts as empty.
    """
    words, hashes = f"_{into}_words", f"_{into}_hashes"
    threshold = F.lit((1 << 63) // scale)
    rows = rows.withColumn(
        words,
        F.transform(
            F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"),
            lambda w: F.when(w == "", F.lit(None)).otherwise(F.xxhash64(w)),
        ),
    ).withColumn(words, F.array_compact(words))
    # References to a column inside a lambda read it; an expression would be run per element.
    all_hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))),
        lambda i: F.shiftrightunsigned(
            F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]), 1
        ),
    )
    rows = rows.withColumn(hashes, F.when(F.size(words) > 0, all_hashes))
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < threshold)))
    sketch = (
        F.when(F.col(hashes).isNull(), F.array().cast("array<bigint>"))
        .when(F.exists(hashes, lambda h: h < threshold), kept)
        .otherwise(F.array(F.array_min(hashes)))
    )
    return rows.withColumn(into, sketch).drop(words, hashes)


def merge(a: str | Column, b: str | Column, scale: int = SCALE) -> Column:
    """Sketch of two documents taken together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < F.lit((1 << 63) // scale))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike, one empty sketch is not."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(small: str | Column, large: str | Column) -> Column:
    """Estimated share of ``small``'s shingles that ``large`` holds; an empty one is contained."""
    small, large = (F.col(x) if isinstance(x, str) else x for x in (small, large))
    shared = F.size(F.array_intersect(small, large))
    return F.when(F.size(small) == 0, F.lit(1.0)).otherwise(shared / F.size(small))


def as_text(sketch: str | Column) -> Column:
    """A sketch as 16 hexadecimal digits per hash, joined by spaces."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row with the next doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id between quantiles, so no task holds more than
    its range. The first document of each range is dealt to the range before it as
    well, where it closes the window; this is exact whatever the quantiles are. The
    quantiles, at most ``MOST_BUCKETS`` ids, are all that reaches the driver. Rows
    of one doc_id follow each other by their columns; rows without one come last.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    wanted = min(MOST_BUCKETS, n // ROWS_PER_BUCKET)
    shares = [i / (wanted + 1) for i in range(wanted + 1)]
    found = ids.agg(
        F.percentile_approx("doc_id", shares, 100 * (wanted + 1)).alias("at"),
        F.min("doc_id").alias("least"),
    ).first()
    bounds = sorted({*(found["at"] or []), *([found["least"]] if found["least"] is not None else [])})
    at = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    last = max(len(bounds) - 1, 0)
    # Binary search for the last bound that is not above the id.
    steps = [1 << s for s in reversed(range(max(len(bounds), 1).bit_length()))]
    place = (
        F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda lo, step: F.when(
                (lo + step <= F.lit(len(bounds))) & (F.get(at, lo + step - 1) <= F.col("doc_id")),
                lo + step,
            ).otherwise(lo),
        )
        - 1
    )
    bucket = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(place)
    opens = F.array_contains(at, F.col("doc_id"))
    before = F.when(F.col("_bucket") == 0, F.lit(last)).otherwise(F.col("_bucket") - 1)
    dealt = (
        docs.withColumn("_bucket", bucket)
        .withColumn(
            "_copies",
            F.when(
                opens,
                F.array(
                    F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")),
                    F.struct(before.alias("b"), F.lit(True).alias("guest")),
                ),
            ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")))),
        )
        .select("doc_id", *columns, F.explode("_copies").alias("_at"))
        .select("doc_id", *columns, "_at.b", "_at.guest")
    )
    order = Window.partitionBy("b").orderBy("guest", F.asc_nulls_last("doc_id"), *columns)
    following = {f"next_{c}": F.lead(c).over(order) for c in columns}
    if not bounds:  # only rows without an id, in one range: the first follows the last
        whole = Window.partitionBy("b").orderBy(*columns)
        every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = {
            f"next_{c}": F.when(
                F.row_number().over(whole) == F.count(F.lit(1)).over(every),
                F.first(c).over(every),
            ).otherwise(F.lead(c).over(whole))
            for c in columns
        }
    return dealt.withColumns(following).where(~F.col("guest")).drop("b", "guest")


def fingerprint_edits(docs: DataFrame, k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Every document's fingerprint beside those of an edited text and of the next document.

    The edit replaces the last floor(n_chars / 2) code points by as many first ones
    of the next document (all, if it has fewer). Null texts are empty and have an
    empty fingerprint; a single document is its own next one; repeated rows of a
    doc_id each give a row; an empty table gives none. Only doc_id and text are read.
    """
    texts = documents_of(docs, "doc_id", "text").withColumn(
        "text", F.coalesce(F.col("text"), F.lit(""))
    )
    rows = with_next(with_sketch(texts, "text", "sketch", k, scale), ["text", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited",
        F.concat(
            F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.col("next_text").substr(F.lit(1), half),
        ),
    )
    rows = with_sketch(rows, "edited", "edited_sketch", k, scale)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("edited_sketch", "sketch").alias("edited_in_text"),
    )
