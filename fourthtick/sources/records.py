"""Records of CSV files that are read in splits although quoted texts run over lines.

A split does not know whether it begins inside a quoted text. Whether a line does is the
parity of all quotes before it: counted per split, summed up over the splits of a file and
then over the lines of a split. A doubled quote counts twice and changes nothing.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fourthtick.sources.staging import stage

_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, the start of its split and a number that grows within the split."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .withColumn("odd", quotes % 2)
    )


def _splits(lines: DataFrame) -> DataFrame:
    """Per split, lines with an odd number of quotes in it and before it, and its first line."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.groupBy(*_SPLIT)
        .agg(F.sum("odd").alias("odds"), F.min(F.struct("line", "value")).alias("first"))
        .withColumn("before", F.coalesce(F.sum("odds").over(earlier), F.lit(0)))
    )


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(record): the text of every record below ``path`` but the header of each file.

    Lines are joined to records where a quoted text holds the break; all others are
    records as they are and travel no further. Empty lines between records are left
    out. A header other than ``columns`` and a file that ends inside a quoted text
    raise ValueError. One row per split is staged while the plan is built.
    """
    lines = _lines(spark, path)
    splits = stage(_splits(lines), "csv-splits")
    _check_headers(splits, columns)
    _check_ends(splits)

    so_far = Window.partitionBy(*_SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    header = F.when(F.col("block") == 0, F.col("first.line"))
    placed = (
        lines.join(splits.select(*_SPLIT, "before", header.alias("header")), _SPLIT)
        .withColumn("seen", F.col("before") + F.coalesce(F.sum("odd").over(so_far), F.lit(0)))
        .where("header IS NULL OR line <> header")
    )
    # A record of several lines is named by the number of the odd line that opens it.
    inside = F.col("seen") % 2 == 1
    opened = F.when(inside, F.col("seen")).when(F.col("odd") == 1, F.col("seen") + 1)
    placed = placed.withColumn("opened", opened)
    single = placed.where("opened IS NULL").select(F.col("value").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    several = (
        placed.where("opened IS NOT NULL")
        .groupBy("file", "opened")
        .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
        .select("record")
    )
    record = F.regexp_replace("record", r"\r\z", "")
    return single.unionByName(several).select(record.alias("record")).where(F.trim("record") != "")


def _check_headers(splits: DataFrame, columns: list[str]) -> None:
    """At most a few rows reach the driver: headers that differ from the expected, with one file each."""
    wanted = [name.lower() for name in columns]
    heads = splits.where("block = 0").groupBy(F.col("first.value").alias("header"))
    for row in heads.agg(F.min("file").alias("file")).limit(100).collect():
        names = next(csv.reader([row["header"].rstrip("\r")]), [])
        if [name.strip().lower() for name in names] != wanted:
            raise ValueError(f"{row['file']} has the columns {names}, not {columns}")


def _check_ends(splits: DataFrame) -> None:
    odd = splits.groupBy("file").agg(F.sum("odds").alias("odds")).where("odds % 2 = 1")
    if open_ := [row["file"] for row in odd.select("file").limit(10).collect()]:
        raise ValueError(f"a quoted text is not closed at the end of {', '.join(open_)}")


def parsed_records(records: DataFrame, schema: StructType, bad: str) -> DataFrame:
    """Columns of ``schema`` of every record, and its text as ``bad`` where it does not fit."""
    fields = [*schema.fields, StructType().add(bad, "string").fields[0]]
    wanted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": '"'}
    return records.select(F.from_csv("record", wanted, options).alias("_row")).select("_row.*")
