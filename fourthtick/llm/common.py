"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column of the caller can clash with ours."""
    return docs.select(*[docs[name] for name in columns])


def crc_bucket(doc_id: str | Column = "doc_id", buckets: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``buckets``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side with at most so many rows of a few numbers each is broadcast.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame) -> DataFrame:
    """Staged ``rows`` of a few numbers each, marked for broadcast if a count proves them few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Text read at once by a task that turns it into something larger.
BATCH_BYTES = 4 << 20


#: Rows that a task reads at once from stored texts, instead of 4096.
BATCH_ROWS = 256


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run meanwhile sends Python batches of about ``limit`` bytes and reads ``rows`` at once, at most.

    A batch stands in the memory of both sides at once; by default it is 64 MB. What is
    read at once stands in arrays of that many texts, which the heap keeps apart, in large pieces.
    """
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": limit,
        "spark.sql.parquet.columnarReaderBatchSize": rows,
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before and after them what the worker's Arrow pool holds unused is given back.

    Workers are used again by later tasks, which would have it on top of their own.
    """
    pa.default_memory_pool().release_unused()
    yield from batches
    pa.default_memory_pool().release_unused()


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each, one row at least."""
    for batch in released(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()["n"] or 0


def without_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """id and row of the documents but those with a (doc_id, text_key) of staged ``gone``.

    text_key is xxhash64 of the text. The caller's columns travel as one, row, so that none
    of them can clash with ours; ``own_columns`` gives them back.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), row)
    gone = bounded(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    return whole.join(gone, same, "left_anti").select("id", "row")


def own_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
