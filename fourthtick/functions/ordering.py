"""Sort keys that rank NULLs above every value, in both directions.

The stored data follows the convention that NULL sorts as the largest value.
``min_by`` on such a key picks the first row of the described order with a
map-side partial aggregate, so one huge group never gathers in one task.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascending(name: str) -> list[Column]:
    """Smallest first, NULL last."""
    return [F.col(name).isNull(), F.col(name)]


def descending(name: str) -> list[Column]:
    """Largest first, NULL before everything. For numeric columns."""
    return [F.col(name).isNotNull(), -F.col(name)]


def sort_key(*parts: list[Column]) -> Column:
    """One comparable struct out of ``ascending`` / ``descending`` parts."""
    flat = [column for part in parts for column in part]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(flat)])
