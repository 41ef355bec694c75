from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourthtick import schemas
from fourthtick.tables import Tables


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are NULL in some part or occur more than once, with their row count."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("occurrences"))
        .filter(missing | (F.col("occurrences") > 1))
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-NULL child values without a parent row, with the number of child rows.

    Child rows are counted per value before the anti join, so a frequent value
    travels as one row per map task.
    """
    counted = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("orphan_key"))
        .agg(F.count("*").alias("occurrences"))
    )
    known = parent.select(F.col(parent_column).alias("orphan_key"))
    return counted.join(known, "orphan_key", "left_anti")


def check_keys(tables: Tables) -> DataFrame:
    """One row per primary key and per required column, with its number of violations."""
    checks = []
    for name, rows in tables.named().items():
        bad_keys = key_violations(rows, schemas.KEYS[name])
        checks.append(_report(bad_keys, name, ", ".join(schemas.KEYS[name]), "primary key"))
        for column in schemas.REQUIRED.get(name, []):
            empty = rows.filter(F.col(column).isNull())
            checks.append(_report(empty, name, column, "not null"))
    return reduce(DataFrame.unionByName, checks)


def check_references(tables: Tables) -> DataFrame:
    """One row per foreign key, with its number of orphaned values and rows."""
    stored = tables.named()
    checks = []
    for child, column, parent, parent_column in schemas.REFERENCES:
        found = orphans(stored[child], column, stored[parent], parent_column)
        checks.append(
            found.agg(
                F.count("*").alias("orphan_keys"),
                F.coalesce(F.sum("occurrences"), F.lit(0)).alias("orphan_rows"),
            ).select(
                F.lit(child).alias("child_table"),
                F.lit(column).alias("child_column"),
                F.lit(parent).alias("parent_table"),
                "orphan_keys",
                "orphan_rows",
            )
        )
    return reduce(DataFrame.unionByName, checks)


def _report(violations: DataFrame, table: str, columns: str, rule: str) -> DataFrame:
    return violations.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table_name"),
        F.lit(columns).alias("columns"),
        F.lit(rule).alias("rule"),
        "violations",
    )
