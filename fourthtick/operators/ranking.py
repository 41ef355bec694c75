from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.operators.slices import SLICE_ROWS, in_slices, slice_borders


def rank_by_time(
    rows: DataFrame,
    by: str,
    time: str,
    rank: str,
    lookup: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact ``row_number`` per key in time order, without gathering a large key in one task.

    Keys with more than ``slice_rows`` rows, found by a count while the plan is built, are
    ranked inside slices of time that hold about as many, and every slice starts from the
    number of rows in the key's earlier slices. The slice counts are aggregated
    map-side; what meets per key is one counter per slice. Rows without a key or a time
    are ranked like any others, NULL first.

    ``lookup`` (one row per key) is joined in; rows without a lookup match are dropped.
    """
    borders = slice_borders([rows], by, time, slice_rows)
    if borders is None:
        in_time = Window.partitionBy(by).orderBy(time)
        ranked = rows.withColumn(rank, F.row_number().over(in_time).cast("long"))
        return ranked if lookup is None else ranked.join(lookup, by)

    sliced = in_slices(rows, borders, by, time)
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(by, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    if lookup is not None:
        offsets = offsets.join(lookup, by)

    inside = Window.partitionBy(by, "_slice").orderBy(time)
    found = offsets.withColumnsRenamed({by: "_key", "_slice": "_of"})
    same = F.col(by).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of"))
    return (
        sliced.join(found, same)
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_slice", "_before", "_key", "_of")
    )
