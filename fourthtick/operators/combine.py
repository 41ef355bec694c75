from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Merge frames of exactly one row and disjoint columns into one row.

    The rows are stacked, each with NULLs for the others' columns, and folded
    with ``max``, so no join is needed.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def sort_any(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Order a result by any of its columns.

    Text ignores case; a missing number counts as 0. The other columns break
    ties, so the order is the same in every run.
    """
    kind = dict(rows.dtypes)[column]
    if kind == "string":
        key = F.lower(column)
    elif kind in ("float", "double"):
        key = F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))
    elif kind in ("int", "bigint") or kind.startswith("decimal"):
        key = F.coalesce(F.col(column), F.lit(0))
    else:
        key = F.col(column)
    rest = [F.col(c) for c in rows.columns if c != column]
    return rows.orderBy(key.asc() if ascending else key.desc(), *rest)
