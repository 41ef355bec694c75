"""Views the reports build on.

Candles and plays are the two large tables, and a single market or game may
hold a large part of them. Everything here first reduces them to one row per
market or game with map-side partial aggregates and joins only afterwards.

No join is hinted: sizes decide. Spark broadcasts a side whose size is below
``spark.sql.autoBroadcastJoinThreshold`` (estimated at planning, measured at
run time) and shuffles both otherwise, splitting skewed partitions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourthtick.functions.ordering import ascending, descending, sort_key
from fourthtick.operators.ranking import rank_by_time
from fourthtick.sources.storage import stage
from fourthtick.tables import Facts, Tables

TRADED = "kalshi_close > 0"

# Before the last two minutes, in which the model only confirms the outcome.
CONTESTED = "NOT (qtr = 4 AND quarter_seconds_remaining < 120)"


def first_play() -> Column:
    """Sort key whose minimum is the first play of a game."""
    return sort_key(ascending("qtr"), descending("quarter_seconds_remaining"), ascending("play_id"))


def last_play() -> Column:
    """Sort key whose minimum is the last play of a game."""
    return sort_key(descending("qtr"), ascending("quarter_seconds_remaining"), descending("play_id"))


def pregame_prices(t: Tables) -> DataFrame:
    """Every traded candle with its rank in time; rank 1 is the pregame price.

    For a filter on the first ranks Spark cuts every map task's candles to these before it
    moves them, unless some market is so large that it is ranked in slices.
    """
    return rank_by_time(
        t.prices.filter(TRADED).select("market_ticker", "datetime_utc", "kalshi_close"),
        by="market_ticker",
        time="datetime_utc",
        rank="rn",
        lookup=t.markets.select("market_ticker", "game_id", "target_team"),
    ).select("market_ticker", "game_id", "target_team", "kalshi_close", "rn")


def first_prices(t: Tables) -> DataFrame:
    """The rank-1 rows of ``pregame_prices``, by aggregation instead of ranking."""
    if t.market_facts is not None:
        first = t.market_facts.filter(F.col("pregame_close").isNotNull()).select(
            "market_ticker", F.col("pregame_close").alias("kalshi_close")
        )
    else:
        first = (
            t.prices.filter(TRADED)
            .groupBy("market_ticker")
            .agg(F.min_by("kalshi_close", "datetime_utc").alias("kalshi_close"))
        )
    markets = t.markets.select("market_ticker", "game_id", "target_team")
    return markets.join(first, "market_ticker").select(
        "market_ticker", "game_id", "target_team", "kalshi_close"
    )


def market_facts(t: Tables) -> DataFrame:
    """One row per market: pregame price (NULL if never traded), lowest and highest close."""
    if t.market_facts is not None:
        return t.market_facts
    return t.prices.groupBy("market_ticker").agg(
        F.min_by("kalshi_close", F.when(F.expr(TRADED), F.col("datetime_utc"))).alias("pregame_close"),
        F.min("kalshi_close").alias("min_close"),
        F.max("kalshi_close").alias("max_close"),
    )


def play_facts(t: Tables) -> DataFrame:
    """One row per game: final score, kickoff probability, probability range before garbage time."""
    if t.play_facts is not None:
        return t.play_facts
    has_wp = F.col("vegas_wp").isNotNull()
    contested_wp = F.when(F.expr(CONTESTED), F.col("vegas_wp"))
    final = F.struct("total_home_score", "total_away_score")
    return (
        t.plays.groupBy("game_id")
        .agg(
            F.min_by(final, last_play()).alias("final"),
            F.min_by("vegas_wp", F.when(has_wp, first_play())).alias("home_vegas_wp"),
            F.min(contested_wp).alias("min_home_wp"),
            F.max(contested_wp).alias("max_home_wp"),
        )
        .select("game_id", "final.*", "home_vegas_wp", "min_home_wp", "max_home_wp")
    )


def finished_games(t: Tables) -> DataFrame:
    """``play_facts`` with the game's attributes and its winner (NULL on a tie)."""
    home, away = F.col("total_home_score"), F.col("total_away_score")
    winner = F.when(home > away, F.col("home_team")).when(away > home, F.col("away_team"))
    games = t.games.select("game_id", "week", "home_team", "away_team")
    return play_facts(t).join(games, "game_id").withColumn("winner", winner)


def game_results(t: Tables) -> DataFrame:
    """Winner of each game after its last play; NULL on a tie."""
    return finished_games(t).select("game_id", "winner")


def game_volatility(t: Tables) -> DataFrame:
    """Highest minus lowest close per game, zero closes included."""
    return (
        market_facts(t)
        .join(t.markets.select("market_ticker", "game_id"), "market_ticker")
        .groupBy("game_id")
        .agg((F.max("max_close") - F.min("min_close")).alias("price_swing"))
    )


def first_play_wp(t: Tables) -> DataFrame:
    """Home win probability at the first play of each game that has one."""
    if t.play_facts is not None:
        return t.play_facts.filter(F.col("home_vegas_wp").isNotNull()).select(
            "game_id", "home_vegas_wp"
        )
    return (
        t.plays.filter(F.col("vegas_wp").isNotNull())
        .groupBy("game_id")
        .agg(F.min_by("vegas_wp", first_play()).alias("home_vegas_wp"))
    )


def outcomes(t: Tables) -> DataFrame:
    """Pregame price of each market next to its game's result. A tie counts as not won."""
    won = F.when(F.col("winner") == F.col("target_team"), 1.0).otherwise(0.0)
    results = finished_games(t).select("game_id", "week", "winner")
    return first_prices(t).join(results, "game_id").withColumn("won", won)


def favorite_summary(t: Tables) -> DataFrame:
    """Pregame probability and outcome of each market's team."""
    return outcomes(t).select(
        "game_id",
        F.col("target_team").alias("favorite_team"),
        F.col("kalshi_close").alias("favorite_prob"),
        F.col("won").alias("favorite_won"),
    )


def with_facts(t: Tables, folder: str | None = None) -> Tables:
    """Write both fact summaries once and return tables whose reports read them.

    One pass over candles and one over plays then serve every report that needs
    only per-market or per-game facts.
    """
    return replace(
        t,
        facts_of_prices=Facts(stage(market_facts(t), "market_facts", folder), t.prices),
        facts_of_plays=Facts(stage(play_facts(t), "play_facts", folder), t.plays),
    )


# Fixed names under which the views are published.
VIEWS = {
    "pregame_prices": pregame_prices,
    "game_results": game_results,
    "game_volatility": game_volatility,
    "favorite_summary": favorite_summary,
}


def publish_views(t: Tables, prefix: str = "") -> None:
    """Register the five tables and the four views for ``spark.sql``.

    Temporary views of the same names are replaced; ``prefix`` keeps ours apart.
    """
    for name, rows in t.named().items():
        rows.createOrReplaceTempView(prefix + name)
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(prefix + name)
