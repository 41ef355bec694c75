"""Landed files picked up once: a file stream whose batches become increments of the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourthtick import schemas
from fourthtick.plans import ingest
from fourthtick.sources import storage
from fourthtick.sources.staging import exists, stage, staging
from fourthtick.tables import Tables

#: Folders of a landing place, by what they hold.
FOLDERS = ("play_by_play", "markets", "candles")

_FILES = "path string, modificationTime timestamp, length long, content binary"


def take_in(
    spark: SparkSession, landed: str, store: str, max_files: int = 10_000, **settings
) -> int:
    """Add to the stored tables what has landed since the last call; the number of increments made.

    A stream over the folders ``play_by_play``, ``markets`` and ``candles`` of ``landed`` tells
    which files are new; its checkpoint in ``store`` knows the others, which are not opened
    again. Only names go through the stream, at most ``max_files`` a batch; the files are
    read by the readers of ``storage``. Each batch is an increment named after its number. A
    call that ended half way leaves a batch that the next call makes anew, without what the
    broken attempt has stored.

    Files may land in any order but one: candles no later than the list that names their
    market. Market lists of games that are not known yet, and candles of markets that are
    not, wait in the store. ``settings`` are those of ``ingest.build_increment``. Tables that are not there
    yet are made empty.
    """
    if not exists(spark, f"{store}/{next(iter(schemas.TABLES))}"):
        empty = [spark.createDataFrame([], schema) for schema in schemas.TABLES.values()]
        storage.save_tables(Tables(*empty), store)
    made = []

    def store_batch(files: DataFrame, number: int) -> None:
        paths = [row["path"] for row in files.select("path").collect()]
        if paths:
            add_files(spark, paths, store, f"landing-{number:09d}", **settings)
            made.append(number)

    stream = spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", max_files)
    query = (
        stream.load(f"{landed}/{{{','.join(FOLDERS)}}}")
        .select("path")
        .writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", f"{store}/_landing")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(made)


def add_files(spark: SparkSession, paths: list[str], store: str, increment: str, **settings) -> None:
    """Store what the files add as the named increment; again, if it has been tried before."""
    kinds = {kind: [p for p in paths if p.rsplit("/", 2)[-2] == kind] for kind in FOLDERS}

    def read(kind: str, reader: Callable, schema) -> DataFrame:
        return reader(spark, kinds[kind]) if kinds[kind] else spark.createDataFrame([], schema)

    known = storage.open_tables(spark, store, without=increment)
    with staging(spark):
        plays = read("play_by_play", storage.read_play_by_play, schemas.RAW_PLAY_BY_PLAY)
        lists = stage(read("markets", storage.read_landed_markets, schemas.LANDED_MARKETS), "lists")
        pages = stage(read("candles", storage.read_landed_candles, schemas.LANDED_CANDLES), "pages")
        waiting_lists = _waiting(spark, store, "markets", schemas.LANDED_MARKETS, increment)
        waiting_pages = _waiting(spark, store, "candles", schemas.LANDED_CANDLES, increment)
        delta, _ = ingest.build_increment(
            plays, waiting_lists.unionByName(lists), waiting_pages.unionByName(pages), known, **settings
        )
        names = storage.STORED_NAMES
        delta = Tables(**{
            attribute: stage(rows, names.get(attribute, attribute))
            for attribute, rows in ((a, getattr(delta, a)) for a in ("teams", "games", "plays", "markets", "prices"))
        })
        # What no game and no market has asked for yet waits for one that does.
        games = known.games.unionByName(delta.games.select(*known.games.columns))
        tickers = settings_of(settings)
        asked = ingest.event_ticker_candidates(games, *tickers).select(F.col("ticker").alias("event_ticker"))
        markets = known.markets.select("market_ticker").unionByName(delta.markets.select("market_ticker"))
        _wait(lists.join(asked.distinct(), "event_ticker", "left_anti"), store, "markets", increment)
        _wait(pages.join(markets.distinct(), "market_ticker", "left_anti"), store, "candles", increment)
        storage.save_increment(delta, store, increment)


def settings_of(settings: dict) -> tuple:
    """Overrides, market codes and prefix, as given or as ``ingest`` has them."""
    return (
        settings.get("overrides", ingest.TICKER_OVERRIDES),
        settings.get("market_codes", ingest.MARKET_CODES),
        settings.get("prefix", ingest.EVENT_PREFIX),
    )


def _wait(rows: DataFrame, store: str, kind: str, increment: str) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/_waiting/{kind}/increment={increment}")


def _waiting(spark: SparkSession, store: str, kind: str, schema, increment: str) -> DataFrame:
    """What earlier increments have left."""
    folder = f"{store}/_waiting/{kind}"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema.toDDL()}, increment string").option("basePath", folder)
    return rows.parquet(f"{folder}/*").where(F.col("increment") != increment).select(*schema.fieldNames())
