from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.operators.slices import SLICE_ROWS, in_slices, slice_borders


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    values: list[str],
    tolerance: timedelta,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Give each left row the latest right row of the same key in [t - tolerance, t].

    Both ends are inclusive. Left rows without a match are dropped, and a NULL key
    or time matches nothing. The result has the left columns plus ``values`` of the
    matched right row.

    Both sides are tagged, put in one frame and read in time order, so no pair of
    rows is ever built and each side is read once. Keys with more than ``slice_rows``
    rows, found by a count while the plan is built, are cut into slices at quantiles
    of their times. A slice starts from the last right row of the key's earlier
    slices, found on one summary row per slice, so its size does not depend on the
    tolerance either.
    """
    candidates = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by),
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_time).alias("at"), *values).alias("_found"),
    )
    seekers = left.filter(F.col(by).isNotNull() & F.col(left_time).isNotNull()).select(
        F.col(by),
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_row"),
    )
    rows = candidates.unionByName(seekers, allowMissingColumns=True)
    borders = slice_borders([candidates, seekers], by, "_at", slice_rows)
    keys = [by]
    if borders is not None:
        rows, keys = _with_carried(in_slices(rows, borders, by, "_at"), by), [by, "_slice"]

    # A right row at exactly the same time sorts before the left row.
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_found", F.last("_found", ignorenulls=True).over(so_far))
        .filter((F.col("_side") == 1) & (F.col("_found.at") >= F.col("_at") - F.lit(tolerance)))
        .select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
    )


def _with_carried(sliced: DataFrame, by: str) -> DataFrame:
    """The rows, and for each slice the last right row of its key's earlier slices if there is one."""
    ends = sliced.groupBy(by, "_slice").agg(
        F.max_by("_found", F.when(F.col("_side") == 0, F.col("_at"))).alias("_last")
    )
    earlier = (
        Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        ends.withColumn("_found", F.last("_last", ignorenulls=True).over(earlier))
        .filter(F.col("_found").isNotNull())
        .select(by, F.col("_found.at").alias("_at"), "_slice", F.lit(0).alias("_side"), "_found")
    )
    return sliced.unionByName(carried, allowMissingColumns=True)


def within_interval(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    tolerance: timedelta,
) -> DataFrame:
    """Left rows that have a right row of the same key in [t - tolerance, t + tolerance].

    The latest right row up to t + tolerance lies in the interval exactly when
    any does, so this semi join is an as-of join seen from the interval's end.
    """
    ends = left.withColumn("_end", F.col(left_time) + F.lit(tolerance))
    return asof_backward(
        ends, right, by, "_end", right_time, values=[], tolerance=2 * tolerance
    ).drop("_end")
