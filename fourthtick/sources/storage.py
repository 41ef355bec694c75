from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourthtick import schemas
from fourthtick.sources import footers, records
from fourthtick.sources.staging import (  # noqa: F401 - callers take them from here
    shared_folder,
    stage,
    staging,
    staging_folder,
)
from fourthtick.tables import STORED_NAMES, Tables

_ATTRIBUTES = {stored: attribute for attribute, stored in STORED_NAMES.items()}


# No file of a large table holds more rows, however few partitions wrote it.
ROWS_PER_FILE = 5_000_000


# Increments are partitions of the stored tables; their column is no column of a table.
_INCREMENT = "increment"
BASE = "base"


def open_tables(spark: SparkSession, folder: str, without: str | None = None) -> Tables:
    """The five stored parquet tables, read with their explicit schemas.

    ``without`` leaves one increment out: what an attempt to store it may have left
    must not count as known when the increment is made anew.
    """

    def stored(name: str) -> DataFrame:
        schema = schemas.TABLES[name]
        rows = spark.read.schema(f"{schema.toDDL()}, {_INCREMENT} string").parquet(f"{folder}/{name}")
        if without is not None:
            rows = rows.where(F.col(_INCREMENT) != without)
        return rows.select(*schema.fieldNames())

    return Tables(**{_ATTRIBUTES.get(name, name): stored(name) for name in schemas.TABLES})


def save_increment(tables: Tables, folder: str, increment: str, partitions: int | None = None) -> None:
    """Store new rows as the named increment, in place of what that increment held before.

    Storing it again, after a failure between two tables or for whatever reason, leaves
    every table as if it had been stored once. Other increments are not touched. The
    rows must not be read from ``folder`` itself: stage them first.
    """
    if increment == BASE or not re.fullmatch(r"[A-Za-z0-9_.-]+", increment):
        raise ValueError(f"not a name for an increment: {increment!r}")
    _save(tables, folder, increment, partitions, "overwrite")


def save_tables(
    tables: Tables, folder: str, partitions: int | None = None, mode: str = "errorifexists"
) -> None:
    """Write the tables as parquet, clustered so that later scans can skip row groups.

    Candles and plays are range-partitioned on their whole key and sorted. One
    hot market or game is thereby cut into many files, and a filter on ticker,
    game or time prunes by the statistics of each row group. ``partitions`` is
    the number of tasks that write each of the two, by default the session's
    number of shuffle partitions; files end after ``ROWS_PER_FILE`` rows.
    ``mode="append"`` adds rows without reading what is stored, and again when repeated;
    ``save_increment`` may be repeated.
    """
    _save(tables, folder, BASE, partitions, mode)


def _save(tables: Tables, folder: str, increment: str, partitions: int | None, mode: str) -> None:
    count = [partitions] if partitions else []
    for name, rows in tables.named().items():
        rows = rows.select(*schemas.TABLES[name].fieldNames())
        if name in ("plays", "kalshi_prices"):
            keys = schemas.KEYS[name]
            rows = rows.repartitionByRange(*count, *keys).sortWithinPartitions(*keys)
        path = f"{folder}/{name}/{_INCREMENT}={increment}"
        rows.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


_BAD = "_bad_row"


def _csv_rows(spark: SparkSession, folder: str, name: str, line_breaks: bool) -> DataFrame:
    """Rows of a landed CSV with their text in ``_BAD`` where they do not fit the schema."""
    schema = schemas.csv_schema(name)
    if line_breaks:
        found = records.csv_records(spark, f"{folder}/{name}.csv", schema.fieldNames())
        return records.parsed_records(found, schema, _BAD)
    return spark.read.schema(schema.add(_BAD, "string")).csv(
        f"{folder}/{name}.csv",
        header=True,
        enforceSchema=False,
        escape='"',
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=_BAD,
    )


def read_csv_table(
    spark: SparkSession, folder: str, name: str, line_breaks: bool = True
) -> DataFrame:
    """One landed CSV file (or folder of files) as its table.

    The file is read in its own column order, then brought to the table's by name.
    A row with a cell that does not fit its type, or with too many or too few cells,
    fails the query and is named in the error; ``rejected_csv_rows`` lists such rows
    instead. Quoted texts may run over several lines: files of any size are split among
    tasks all the same (see ``records``). Where no text does, ``line_breaks=False`` saves
    the step that tells which lines belong together; such a text is then a bad row.
    """
    rows = _csv_rows(spark, folder, name, line_breaks)
    # The check reads every column: whichever the caller wants, the whole row is parsed.
    every = F.xxhash64(*schemas.csv_schema(name).fieldNames()) >= F.lit(-(1 << 63))
    message = F.concat(F.lit(f"bad row in {name}.csv: "), F.coalesce(_BAD, F.lit("")))
    checked = rows.filter(F.assert_true(F.col(_BAD).isNull() & every, message).isNull())
    renamed = {file: table for table, file in schemas.CSV_RENAMED.get(name, {}).items()}
    return checked.withColumnsRenamed(renamed).select(*schemas.TABLES[name].fieldNames())


def rejected_csv_rows(
    spark: SparkSession, folder: str, name: str, line_breaks: bool = True
) -> DataFrame:
    """The rows of a landed CSV that ``read_csv_table`` would fail on: table and text."""
    rows = _csv_rows(spark, folder, name, line_breaks)
    every = F.xxhash64(*schemas.csv_schema(name).fieldNames()) >= F.lit(-(1 << 63))
    return rows.filter(F.col(_BAD).isNotNull() & every).select(
        F.lit(name).alias("table_name"), F.col(_BAD).alias("bad_row")
    )


def write_csv_table(rows: DataFrame, folder: str, name: str, only_if_absent: bool = False) -> None:
    """Write one table as CSV with a header; existing output can be left as it is."""
    renamed = schemas.CSV_RENAMED.get(name, {})
    (
        rows.select(*schemas.CSV_ORDER[name])
        .withColumnsRenamed(renamed)
        .write.mode("ignore" if only_if_absent else "errorifexists")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(f"{folder}/{name}.csv", header=True, escape='"')
    )


def load_tables(spark: SparkSession, folder: str, line_breaks: bool = True) -> Tables:
    """Read the five landed CSV files."""
    return Tables(
        **{
            _ATTRIBUTES.get(name, name): read_csv_table(spark, folder, name, line_breaks)
            for name in schemas.TABLES
        }
    )


def read_play_by_play(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed play-by-play parquet, only the columns the tables need.

    The counters are stored as floats in some files and as integers in others. Footers are
    read by tasks; files of the same types are read together, then brought to one type
    here. A file that lacks a column raises ValueError.
    """
    wanted = schemas.RAW_PLAY_BY_PLAY.fields
    names = [f.name for f in wanted]
    paths = [path] if isinstance(path, str) else path
    parts = []
    for kinds, files in footers.files_by_schema(spark, paths, names):
        if missing := [name for name, kind in zip(names, kinds, strict=True) if kind is None]:
            raise ValueError(f"{(files or paths)[0]} has no column {', '.join(missing)}")
        stored = ", ".join(f"`{name}` {kind}" for name, kind in zip(names, kinds, strict=True))
        parts.append(
            spark.read.schema(stored)
            .parquet(*(files or paths))
            .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        )
    return reduce(DataFrame.unionByName, parts)


def read_landed_markets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed market lists: one JSON line per request, the response body kept as text."""
    return spark.read.schema(schemas.LANDED_MARKETS).json(path)


def read_landed_candles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed candle lists: one JSON line per request, the response body kept as text."""
    return spark.read.schema(schemas.LANDED_CANDLES).json(path)
