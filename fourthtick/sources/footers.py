"""Physical schemas of parquet files, read in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's names of the physical types, where no logical type says otherwise.
_KINDS = {
    "BOOLEAN": "boolean",
    "INT32": "int",
    "INT64": "bigint",
    "FLOAT": "float",
    "DOUBLE": "double",
    "BYTE_ARRAY": "string",
}


def _kind(column: pq.ColumnSchema) -> str:
    logical = column.logical_type.type
    if logical == "DATE":
        return "date"
    if logical in ("NONE", "STRING", "INT", "ENUM", "JSON") and column.physical_type in _KINDS:
        return _KINDS[column.physical_type]
    return f"{column.physical_type} {logical}".lower()


def physical_schemas(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """(file, kinds): of every parquet file below ``path``, the stored type of each column.

    The list of files is a table and footers are read by the tasks that hold it: the
    driver lists the folder, opens no file and starts one job however many there are.
    A file without a column has NULL in its place; one without a whole footer fails
    the query by name. Of each file's bytes only the footer leaves the reader; a file
    may have up to 2 GB, which is what one value of a row holds.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 8")
    # The last eight bytes are the footer's length, lowest byte first, and the mark.
    size = F.hex(F.expr("substring(content, -8, 4)"))
    lowest_last = F.concat(*[F.substring(size, at, 2) for at in (7, 5, 3, 1)])
    files = files.withColumn("footer", F.conv(lowest_last, 16, 10).cast("int"))
    tails = files.select("path", F.expr("substring(content, -(footer + 8))").alias("tail"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for path, tail in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    stored = pq.read_metadata(pa.BufferReader(tail.as_buffer())).schema
                except pa.ArrowInvalid as error:
                    raise ValueError(f"{path} is no whole parquet file: {error}") from error
                found = {c.path: _kind(c) for c in map(stored.column, range(len(stored)))}
                kinds.append([found.get(name) for name in columns])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string()))], names=["file", "kinds"]
            )

    return tails.mapInArrow(read, "file string, kinds array<string>")


def files_by_schema(
    spark: SparkSession, path: str | list[str], columns: list[str]
) -> list[tuple[list[str | None], list[str] | None]]:
    """Each set of physical types with its files, or with None where all files are alike.

    One row per set reaches the driver. Only where there are several do the names of
    files come with them, which a reader of single files needs there.
    """
    # Two looks at the footers would read the files twice: the names are kept as a list at once.
    alike = physical_schemas(spark, path, columns).groupBy("kinds")
    found = sorted(alike.agg(F.sort_array(F.collect_list("file")).alias("files")).collect(), key=str)
    if len(found) == 1:
        return [(found[0]["kinds"], None)]
    return [(row["kinds"], row["files"]) for row in found]
