"""Slices of time for keys that are too large for one task, cut where their rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourthtick.sources.staging import stage

#: Rows of a key that one task may take; beyond it the key is cut into slices of about as many.
SLICE_ROWS = 1_000_000
#: Slices of a key at most: the quantiles that a summary of its times gives.
MOST_SLICES = 256


def slice_borders(frames: list[DataFrame], by: str, time: str, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """(by, borders) of the keys with more than ``slice_rows`` rows in all frames together; None without such.

    Borders are quantiles of a mergeable summary of the key's times, so slices hold about
    equal numbers of rows however they lie in time: a key whose rows fall into one second is
    cut as finely as one of a year. Rows of one and the same time stay together. Keys are
    counted first, in sums that are small before they travel; times are read of large keys
    only, of which there are at most as many as ``slice_rows`` goes into all rows. The
    borders are staged while the plan is built.
    """
    counts = reduce(
        DataFrame.unionByName,
        [rows.groupBy(by).agg(F.count("*").alias("_n")) for rows in frames],
    )
    large = counts.groupBy(by).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > slice_rows)
    large = stage(large, "large-keys")
    if large.isEmpty():
        return None
    times = reduce(DataFrame.unionByName, [rows.select(by, time) for rows in frames])
    shares = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    quantiles = (
        times.join(large, by)
        .groupBy(by, "_n")
        .agg(F.percentile_approx(time, shares, 10_000).alias("_at"))
    )
    parts = F.least(F.lit(MOST_SLICES), F.ceil(F.col("_n") / slice_rows)).cast("int")
    chosen = F.transform(
        F.sequence(F.lit(1), parts - 1),
        lambda i: F.element_at("_at", F.call_function("div", i * MOST_SLICES, parts).cast("int")),
    )
    return stage(quantiles.select(by, F.array_distinct(chosen).alias("_borders")), "borders")


def slice_of(time: str) -> Column:
    """Number of the slice of a row next to its key's borders: those at or before its time."""
    return F.coalesce(F.size(F.filter("_borders", lambda b: b <= F.col(time))), F.lit(0))


def in_slices(rows: DataFrame, borders: DataFrame, by: str, time: str) -> DataFrame:
    """Rows with their ``_slice``; 0 for keys without borders."""
    found = borders.withColumnRenamed(by, "_key")
    sliced = rows.join(found, F.col(by) == F.col("_key"), "left")
    number = F.when(F.col("_borders").isNull(), 0).otherwise(slice_of(time))
    return sliced.withColumn("_slice", number).drop("_key", "_borders")
