"""Fact summaries kept up to date by increments: states that merge, one row per market and game.

A state keeps what decides beside what is decided: the time of the first price beside the
price, the sort key of the last play beside the score. States of any parts of a table
merge by the same aggregates that made them, in any order and grouping.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourthtick.plans.views import CONTESTED, TRADED, first_play, last_play
from fourthtick.sources.staging import stage, staging
from fourthtick.sources.storage import BASE
from fourthtick.tables import Facts, Tables

_MARKETS, _GAMES = "market_states", "game_states"


def market_states(prices: DataFrame) -> DataFrame:
    """Per market the first traded price with its time, the lowest and highest close, and the candles."""
    first = F.struct(F.col("datetime_utc").alias("at"), F.col("kalshi_close").alias("close"))
    return prices.groupBy("market_ticker").agg(
        F.min(F.when(F.expr(TRADED) & F.col("datetime_utc").isNotNull(), first)).alias("first"),
        F.min("kalshi_close").alias("min_close"),
        F.max("kalshi_close").alias("max_close"),
        F.count("*").alias("candles"),
    )


def merged_markets(states: DataFrame) -> DataFrame:
    return states.groupBy("market_ticker").agg(
        F.min("first").alias("first"),
        F.min("min_close").alias("min_close"),
        F.max("max_close").alias("max_close"),
        F.sum("candles").alias("candles"),
    )


def game_states(plays: DataFrame) -> DataFrame:
    """Per game the last play's score and the first known probability with their keys, and the range."""
    final = F.struct(last_play().alias("key"), "total_home_score", "total_away_score")
    first = F.struct(first_play().alias("key"), "vegas_wp")
    contested = F.when(F.expr(CONTESTED), F.col("vegas_wp"))
    return plays.groupBy("game_id").agg(
        F.min(final).alias("final"),
        F.min(F.when(F.col("vegas_wp").isNotNull(), first)).alias("first"),
        F.min(contested).alias("min_home_wp"),
        F.max(contested).alias("max_home_wp"),
    )


def merged_games(states: DataFrame) -> DataFrame:
    return states.groupBy("game_id").agg(
        F.min("final").alias("final"),
        F.min("first").alias("first"),
        F.min("min_home_wp").alias("min_home_wp"),
        F.max("max_home_wp").alias("max_home_wp"),
    )


def add_states(increment_rows: Tables, folder: str, increment: str = BASE) -> None:
    """Store the states of an increment's candles and plays; nothing else is read.

    Stored again, it replaces itself.
    """
    for name, rows in (
        (_MARKETS, market_states(increment_rows.prices)),
        (_GAMES, game_states(increment_rows.plays)),
    ):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/increment={increment}")


def _states(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").drop("increment")


def with_states(t: Tables, folder: str) -> Tables:
    """Tables whose reports read the facts that the states of all increments give.

    One row per market or game and increment is merged, however many candles and plays there are.
    """
    spark = t.spark
    markets = merged_markets(_states(spark, folder, _MARKETS)).select(
        "market_ticker", F.col("first.close").alias("pregame_close"), "min_close", "max_close"
    )
    games = merged_games(_states(spark, folder, _GAMES)).select(
        "game_id",
        "final.total_home_score",
        "final.total_away_score",
        F.col("first.vegas_wp").alias("home_vegas_wp"),
        "min_home_wp",
        "max_home_wp",
    )
    return replace(
        t, facts_of_prices=Facts(markets, t.prices), facts_of_plays=Facts(games, t.plays)
    )


def compact_states(spark: SparkSession, folder: str, into: str) -> None:
    """Write the merged states of all increments to another folder, as its base."""
    with staging(spark):
        for name, merge in ((_MARKETS, merged_markets), (_GAMES, merged_games)):
            whole = stage(merge(_states(spark, folder, name)), name)
            whole.write.mode("overwrite").parquet(f"{into}/{name}/increment={BASE}")
