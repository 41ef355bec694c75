"""Exact distinct counts that merge: keys are numbered once, sets of numbers are bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourthtick.sources.staging import stage


def numbered(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, number) of every distinct key that is not NULL, one number each; ``known`` ones keep theirs.

    Numbers run on within a task, so keys share bitmaps; they need not be consecutive.
    """
    new = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return stage(new.select(key, F.monotonically_increasing_id().alias("number")), "numbers")
    after = (known.agg(F.max("number").alias("n")).first()["n"] or 0) + 1
    new = new.join(known.select(key), key, "left_anti")
    added = new.select(key, (F.monotonically_increasing_id() + after).alias("number"))
    return stage(known.select(key, "number").unionByName(added), "numbers")


def key_sets(rows: DataFrame, group: str, key: str, numbers: DataFrame) -> DataFrame:
    """(group, bucket, keys): the set of keys of each group, as bitmaps of 32,768 numbers each."""
    number = F.col("number")
    return (
        rows.select(group, key)
        .join(numbers, key)
        .groupBy(group, F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("keys"))
    )


def merged_sets(sets: DataFrame, *by: str) -> DataFrame:
    """The union of sets of any parts, kept apart by the columns ``by``."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("keys").alias("keys"))


def set_sizes(sets: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Distinct keys of all sets together, or per ``by``."""
    size = F.coalesce(F.sum(F.bitmap_count("keys")), F.lit(0)).alias(name)
    return merged_sets(sets, *by).groupBy(*by).agg(size)
