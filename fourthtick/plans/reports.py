"""The reports. Each takes the tables and its thresholds and returns a DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.functions.rounding import exact, round_half_up
from fourthtick.functions.times import EASTERN, time_slice, utc_to_wall, wall_to_utc
from fourthtick.operators.asof import asof_backward, within_interval
from fourthtick.operators.combine import side_by_side
from fourthtick.operators.distinct import key_sets, set_sizes
from fourthtick.plans.views import (
    TRADED,
    finished_games,
    first_play_wp,
    first_prices,
    market_facts,
    outcomes,
)
from fourthtick.tables import Tables

REGULAR_SEASON = "week BETWEEN 1 AND 18"


def mean(value: str | Column, digits: int) -> Column:
    return round_half_up(F.avg(value), digits)


def market_bias(t: Tables, min_games: int = 5) -> DataFrame:
    """How far each team's pregame price lies above its real win rate."""
    return (
        outcomes(t)
        .filter(F.col("winner").isNotNull())
        .groupBy("target_team")
        .agg(
            F.count("*").alias("num_games"),
            mean("kalshi_close", 3).alias("avg_market_prob"),
            mean("won", 3).alias("actual_win_rate"),
            mean(F.col("kalshi_close") - F.col("won"), 3).alias("avg_signed_error"),
        )
        .filter(F.col("num_games") >= min_games)
        .orderBy(F.desc("avg_signed_error"), "target_team")
    )


def market_swings(t: Tables, limit: int = 20) -> DataFrame:
    """Markets with the widest price range since midnight of game day."""
    widest = swings(t).orderBy(F.desc("swing"), "game_id", "market_ticker").limit(limit)
    return widest.drop("market_ticker", "swing")


def swings(t: Tables) -> DataFrame:
    """Price range of every market since midnight of game day, rounded and exact.

    Midnight is a day boundary, so candles are first reduced to one row per
    market and day; the game date is compared on those.
    """
    daily = (
        t.prices.filter(TRADED)
        .groupBy("market_ticker", F.col("datetime_utc").cast("date").alias("day"))
        .agg(F.min("kalshi_close").alias("low"), F.max("kalshi_close").alias("high"))
    )
    listed = t.markets.select("market_ticker", "game_id", "target_team").join(
        t.games.select("game_id", "game_date", "home_team", "away_team"), "game_id"
    )
    return (
        daily.join(listed, "market_ticker")
        .filter(F.col("day") >= F.col("game_date"))
        .groupBy("game_id", "home_team", "away_team", "market_ticker", "target_team")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("swing", F.col("high") - F.col("low"))
        .select(
            "game_id",
            "home_team",
            "away_team",
            "target_team",
            round_half_up(F.col("low"), 3).alias("min_price"),
            round_half_up(F.col("high"), 3).alias("max_price"),
            round_half_up(F.col("swing"), 3).alias("price_swing"),
            "market_ticker",
            "swing",
        )
    )


def adversity_performance(
    t: Tables, favorite_threshold: float = 0.65, adversity_drop: float = 0.25
) -> DataFrame:
    """Win rate of favorites that did or did not fall far below their kickoff level.

    The favorite's lowest probability follows from the game's lowest or highest
    home probability, so plays are reduced per game before they meet markets.
    """
    favorites = (
        first_prices(t)
        .filter(F.col("kalshi_close") >= favorite_threshold)
        .select("game_id", "target_team", "kalshi_close")
        .distinct()
    )
    at_home = F.col("target_team") == F.col("home_team")
    kickoff = F.when(at_home, F.col("home_vegas_wp")).otherwise(1.0 - F.col("home_vegas_wp"))
    lowest = F.when(at_home, F.col("min_home_wp")).otherwise(1.0 - F.col("max_home_wp"))
    return (
        favorites.join(finished_games(t), "game_id")
        .filter(F.col("winner").isNotNull() & F.col("min_home_wp").isNotNull())
        .groupBy(
            F.when(lowest <= kickoff - adversity_drop, 1)
            .otherwise(0)
            .alias("experienced_major_adversity")
        )
        .agg(
            F.count("*").alias("num_games"),
            mean("kalshi_close", 3).alias("avg_pregame_prob"),
            mean(F.when(F.col("winner") == F.col("target_team"), 1.0).otherwise(0.0), 3).alias(
                "favorite_win_rate"
            ),
        )
        .orderBy("experienced_major_adversity")
    )


def accuracy_by_week(t: Tables) -> DataFrame:
    """Predicted and actual win rate and mean absolute error per regular-season week."""
    return (
        outcomes(t)
        .filter(REGULAR_SEASON)
        .groupBy("week")
        .agg(
            F.count("*").alias("numberoffgames"),
            mean("kalshi_close", 2).alias("avg_predicted"),
            mean("won", 2).alias("actual"),
            mean(F.abs(F.col("kalshi_close") - F.col("won")), 2).alias("error"),
        )
        .orderBy("week")
    )


def game_totals(t: Tables, **counted: Column) -> DataFrame:
    """Per finished game: price swing, and sums over its markets with a pregame price.

    All markets of a game share its swing, so sums per game are enough for any
    average over swing groups, and candles are aggregated once. Markets are first
    summed per game and team, which needs no result yet, so a game with many
    markets is reduced before the join. ``counted`` adds, for a condition on
    ``price``, the number of such markets (``name``) and of their wins
    (``name_won``).
    """
    price = F.col("price")
    per_team = (
        market_facts(t)
        .withColumnRenamed("pregame_close", "price")
        .join(t.markets.select("market_ticker", "game_id", "target_team"), "market_ticker")
        .groupBy("game_id", "target_team")
        .agg(
            F.min("min_close").alias("low"),
            F.max("max_close").alias("high"),
            F.count(price).alias("n"),
            F.sum(price).alias("predicted"),
            F.sum(F.abs(price - 1.0)).alias("error_if_won"),
            F.sum(F.abs(price)).alias("error_if_lost"),
            *[F.count(F.when(condition, 1)).alias(name) for name, condition in counted.items()],
        )
    )
    won = F.coalesce(F.col("winner") == F.col("target_team"), F.lit(False))

    def wins(name: str) -> Column:
        return F.sum(F.when(won, F.col(name)).otherwise(0))

    return (
        per_team.join(finished_games(t).select("game_id", "week", "winner"), "game_id")
        .groupBy("game_id", "week")
        .agg(
            (F.max("high") - F.min("low")).alias("price_swing"),
            F.sum("n").alias("n"),
            F.sum("predicted").alias("predicted"),
            wins("n").alias("n_won"),
            F.sum(
                F.when(won, F.col("error_if_won")).otherwise(F.col("error_if_lost"))
            ).alias("error"),
            *[F.sum(name).alias(name) for name in counted],
            *[wins(name).alias(f"{name}_won") for name in counted],
        )
        .filter(F.col("n") > 0)
    )


def volatility_comparison(t: Tables, volatility_threshold: float = 0.5) -> DataFrame:
    """Accuracy of markets in games with a wide and with a narrow price swing."""
    group = F.when(F.col("price_swing") >= volatility_threshold, "high_volatility").otherwise(
        "low_volatility"
    )
    markets = F.sum("n")
    return (
        game_totals(t)
        .groupBy(group.alias("volatility_group"))
        .agg(
            markets.alias("numberofgames"),
            round_half_up(F.sum("predicted") / markets, 3).alias("avg_predicted_prob"),
            round_half_up(F.sum("n_won") / markets, 3).alias("actual_win_rate"),
            round_half_up(F.sum("error") / markets, 3).alias("avg_error"),
        )
    )


def underdog_win_rate(t: Tables, max_prob: float = 0.4) -> DataFrame:
    """Wins of teams priced at most ``max_prob``; sums are NULL when there is none."""
    return (
        outcomes(t)
        .filter(F.col("kalshi_close") <= max_prob)
        .agg(
            F.count("*").alias("total_underdog_games"),
            F.sum("won").alias("underdog_wins"),
            mean("won", 3).alias("underdog_win_rate"),
        )
    )


def favorite_win_rate(t: Tables, min_prob: float = 0.5) -> DataFrame:
    """Wins of teams priced at least ``min_prob``; sums are 0 when there is none."""
    return (
        outcomes(t)
        .filter(F.col("kalshi_close") >= min_prob)
        .agg(
            F.count("*").alias("total_games"),
            F.coalesce(F.sum("won"), F.lit(0.0)).alias("favorite_wins"),
            F.coalesce(mean("won", 3), F.lit(0.0)).alias("favorite_win_rate"),
        )
    )


def favorite_calibration(t: Tables) -> DataFrame:
    """Predicted and actual win rate of strong, moderate and slight favorites."""
    price = F.col("kalshi_close")
    strength = (
        F.when(price >= 0.8, "strong_favorite")
        .when(price >= 0.6, "moderate_favorite")
        .otherwise("slight_favorite")
    )
    return (
        outcomes(t)
        .filter(price >= 0.5)
        .groupBy(strength.alias("favorite_strength"))
        .agg(
            F.count("*").alias("num_games"),
            mean(price, 2).alias("avg_predicted"),
            mean("won", 2).alias("actual_win_rate"),
        )
        .orderBy("favorite_strength")
    )


def team_market_history(t: Tables, team: str, limit: int = 500) -> DataFrame:
    """Latest candles of the markets on one team, newest first; candles without a time come last.

    The team's candles are counted per hour first, as sums that are small before they
    travel. The hours from the newest on that hold ``limit`` candles give the time from
    which the result is read: a scan that skips older row groups, and the only candles
    that move. The counts are taken while the plan is built.
    """
    markets = t.markets.filter(F.col("target_team") == team.upper()).select(
        "market_ticker", "target_team"
    )
    since = _newest_hours(t.prices, markets, limit)
    prices = t.prices
    if since is not None:
        start = F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")
        prices = prices.filter(F.col("datetime_utc") >= start)
    return (
        prices.join(markets, "market_ticker")
        .orderBy(F.desc("datetime_utc"), "market_ticker")
        .limit(limit)
        .select("market_ticker", "target_team", *t.prices.columns[1:])
    )


def _newest_hours(prices: DataFrame, markets: DataFrame, limit: int) -> datetime | None:
    """Start of the hours that hold the newest ``limit`` candles of the markets; None for all candles."""
    hour = time_slice(F.col("datetime_utc"), 3600).alias("hour")
    counts = (
        prices.groupBy("market_ticker", hour)
        .agg(F.count("*").alias("n"))
        .join(markets, "market_ticker")
        .groupBy("hour")
        .agg(F.sum("n").alias("n"))
    )
    # Every hour counted holds a candle, so no more than ``limit`` hours are needed.
    found = 0
    for row in counts.orderBy(F.desc_nulls_last("hour")).limit(limit).collect():
        found += row["n"]
        if found >= limit:
            return None if row["hour"] is None else datetime(1970, 1, 1) + timedelta(hours=row["hour"])
    return None


def early_hype_fade(t: Tables, min_price_drop: float = 0.3, window_size: int = 5) -> DataFrame:
    """Markets whose mean price fell from their first to their last candles.

    Prices are compared with the threshold as decimals, so the result cannot
    hinge on float noise.
    """
    traded = traded_parts(t)
    totals = (
        traded.groupBy("market_ticker")
        .agg(F.count("*").alias("num_candles"), F.sum("kalshi_volume").alias("total_volume"))
        .filter(F.col("num_candles") >= 2 * window_size)
    )
    first_volume = F.coalesce("first_window_volume", F.lit(0))
    share = first_volume / F.nullif(F.col("total_volume"), F.lit(0))
    return (
        totals.join(_edges(traded, window_size), "market_ticker")
        .filter(exact(F.col("early") - F.col("late")) >= exact(F.lit(min_price_drop)))
        .join(t.markets.select("market_ticker", "target_team"), "market_ticker")
        .select(
            "market_ticker",
            "target_team",
            first_volume.alias("first_window_volume"),
            "total_volume",
            round_half_up(share, 3).alias("early_volume_share"),
            round_half_up(F.col("early"), 3).alias("early_price"),
            round_half_up(F.col("late"), 3).alias("late_price"),
            round_half_up(F.col("late") - F.col("early"), 3).alias("price_change"),
            "num_candles",
        )
        .orderBy("price_change", F.desc("early_price"), "market_ticker")
    )


# Parts into which the first ranking of a market's candles is dealt.
RANK_PARTS = 64


def traded_parts(t: Tables) -> DataFrame:
    """Traded candles with the part of their market that they are ranked in first."""
    part = F.pmod(F.xxhash64("datetime_utc"), F.lit(RANK_PARTS)).alias("part")
    return t.prices.filter(TRADED).select(
        "market_ticker", "datetime_utc", "kalshi_close", "kalshi_volume", part
    )


def _edges(dealt: DataFrame, size: int) -> DataFrame:
    """Volume and mean price of each market's first, mean price of its last candles.

    The first (last) ``size`` candles of a market are among the first (last) ``size``
    of each part of it, whatever the parts are. Candles are ranked within parts dealt
    by a hash of their time, then once more over what is left: no task ranks a whole
    hot market, and for short windows Spark cuts every map task's output to ``size``
    rows per part before it moves them.
    """
    def edge(order: Column):
        def kept(rows: DataFrame, *keys: str) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
            return rows.withColumn("rank", rank).filter(F.col("rank") <= size)

        return kept(kept(dealt, "market_ticker", "part"), "market_ticker").groupBy("market_ticker")

    first = edge(F.asc("datetime_utc")).agg(
        F.sum("kalshi_volume").alias("first_window_volume"), F.avg("kalshi_close").alias("early")
    )
    last = edge(F.desc("datetime_utc")).agg(F.avg("kalshi_close").alias("late"))
    return first.join(last, "market_ticker")


def game_coverage(t: Tables) -> DataFrame:
    """How many games have a market, plays, both or no market.

    The three tables are counted per game in one aggregate instead of being
    probed with semi joins, so plays shrink to one row per game and map task.
    """

    def seen(rows: DataFrame, games: int, markets: int, plays: int) -> DataFrame:
        return rows.select(
            "game_id",
            F.lit(games).alias("games"),
            F.lit(markets).alias("markets"),
            F.lit(plays).alias("plays"),
        )

    per_game = (
        seen(t.games, 1, 0, 0)
        .unionByName(seen(t.markets, 0, 1, 0))
        .unionByName(seen(t.plays, 0, 0, 1))
        .groupBy("game_id")
        .agg(F.sum("games").alias("games"), F.max("markets").alias("m"), F.max("plays").alias("p"))
    )

    def games_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("games"))), F.lit(0))

    m, p = F.col("m") == 1, F.col("p") == 1
    return per_game.agg(
        F.coalesce(F.sum("games"), F.lit(0)).alias("total_games"),
        games_where(m).alias("games_with_kalshi"),
        games_where(~m).alias("games_without_kalshi"),
        games_where(p).alias("games_with_plays"),
        games_where(m & p).alias("games_with_complete_data"),
    )


def vegas_vs_market(t: Tables) -> DataFrame:
    """Pregame market price against the model's kickoff probability, per week."""
    home_wp = F.col("home_vegas_wp")
    model = F.when(F.col("target_team") == F.col("home_team"), home_wp).when(
        F.col("target_team") == F.col("away_team"), 1.0 - home_wp
    )
    games = t.games.filter(REGULAR_SEASON).select("game_id", "week", "home_team", "away_team")
    return (
        first_prices(t)
        .join(games, "game_id")
        .join(first_play_wp(t), "game_id")
        .withColumn("model", model)
        .filter(F.col("model").isNotNull())
        .groupBy("week")
        .agg(
            F.count("*").alias("num_games"),
            mean("kalshi_close", 3).alias("avg_kalshi_prob"),
            mean("model", 3).alias("avg_vegas_wp"),
            mean(F.col("kalshi_close") - F.col("model"), 3).alias("avg_diff"),
        )
        .orderBy("week")
    )


def score_vs_market(
    t: Tables,
    tolerance: timedelta = timedelta(minutes=2),
    min_obs: int = 100,
    candle_zone: str = EASTERN,
) -> DataFrame:
    """Home team's price at each live score difference.

    Every play takes the latest candle of the last ``tolerance``. Candles carry
    the wall clock of ``candle_zone``, so play times are brought there first.
    """
    home_markets = (
        t.markets.join(t.games.select("game_id", "home_team"), "game_id")
        .filter(F.col("target_team") == F.col("home_team"))
        .select("market_ticker", "game_id")
    )
    plays = (
        t.plays.filter(
            F.col("timestamp_utc").isNotNull()
            & F.col("vegas_wp").isNotNull()
            & F.col("qtr").between(1, 4)
        )
        .join(home_markets, "game_id")
        .select(
            "market_ticker",
            utc_to_wall(F.col("timestamp_utc"), candle_zone).alias("played_at"),
            (F.col("total_home_score") - F.col("total_away_score")).alias("score_diff"),
            "vegas_wp",
        )
    )
    matched = asof_backward(
        plays,
        t.prices.join(home_markets.select("market_ticker").distinct(), "market_ticker", "left_semi"),
        by="market_ticker",
        left_time="played_at",
        right_time="datetime_utc",
        values=["kalshi_close"],
        tolerance=tolerance,
    )
    return (
        matched.groupBy("score_diff")
        .agg(
            F.count("*").alias("num_observations"),
            mean("kalshi_close", 3).alias("avg_kalshi_home_price"),
            mean("vegas_wp", 3).alias("avg_vegas_wp"),
        )
        .filter(F.col("num_observations") >= min_obs)
        .orderBy("score_diff")
    )


def timestamp_overlap(
    t: Tables, tolerance: timedelta = timedelta(minutes=10), candle_zone: str = EASTERN
) -> DataFrame:
    """One row that shows whether play and candle times overlap at all."""
    played_at, candle_at = F.col("timestamp_utc"), F.col("datetime_utc")
    plays = t.plays.agg(
        F.count(played_at).alias("plays_with_ts"),
        F.count("*").alias("plays_total"),
        F.min(played_at).alias("plays_ts_min"),
        F.max(played_at).alias("plays_ts_max"),
    )
    prices = t.prices.agg(
        F.min(candle_at).alias("kalshi_ts_min"), F.max(candle_at).alias("kalshi_ts_max")
    )
    near = _plays_near_candles(t, tolerance, candle_zone)
    overlap = near.agg(F.countDistinct("game_id").alias("games_with_ts_overlap"))
    return side_by_side(plays, prices, overlap)


def _plays_near_candles(t: Tables, tolerance: timedelta, candle_zone: str) -> DataFrame:
    """Times of plays that have a candle of a market on their game within ``tolerance``."""
    return within_interval(
        t.plays.filter(F.col("timestamp_utc").isNotNull())
        .select("game_id", "timestamp_utc")
        .distinct()
        .join(t.markets.select("market_ticker", "game_id"), "game_id"),
        t.prices.select(
            "market_ticker", wall_to_utc(F.col("datetime_utc"), candle_zone).alias("candle_utc")
        ),
        by="market_ticker",
        left_time="timestamp_utc",
        right_time="candle_utc",
        tolerance=tolerance,
    )


def overlap_sets(
    t: Tables,
    numbers: DataFrame,
    tolerance: timedelta = timedelta(minutes=10),
    candle_zone: str = EASTERN,
) -> DataFrame:
    """(day, bucket, keys): per day the set of games with a candle near a play, to be stored.

    ``numbers`` are those of ``distinct.numbered`` games. Days that are added later are
    counted alone; any range of days is counted from the stored sets, exactly.
    """
    near = _plays_near_candles(t, tolerance, candle_zone)
    days = near.select("game_id", F.col("timestamp_utc").cast("date").alias("day"))
    return key_sets(days, "day", "game_id", numbers)


def overlap_by_day(sets: DataFrame) -> DataFrame:
    """Games with an overlap per day, and of all days (day NULL), from stored ``overlap_sets``."""
    each = set_sizes(sets, "day", name="games_with_ts_overlap")
    whole = set_sizes(sets, name="games_with_ts_overlap").select(
        F.lit(None).cast("date").alias("day"), "games_with_ts_overlap"
    )
    return each.unionByName(whole).orderBy(F.asc_nulls_last("day"))


def filter_plays(
    plays: DataFrame,
    qtr: int | list[int] | None = None,
    down: int | list[int] | None = None,
    ydstogo: tuple[int, int] | None = None,
    play_type: str | list[str] | None = None,
    interception: bool | None = None,
    fumble: bool | None = None,
) -> DataFrame:
    """Plays that meet every given game condition; ``ydstogo`` is an inclusive range.

    The result can replace ``Tables.plays`` in any report.
    """
    chosen = {"qtr": qtr, "down": down, "play_type": play_type}
    for column, wanted in chosen.items():
        if wanted is not None:
            wanted = wanted if isinstance(wanted, (list, tuple)) else [wanted]
            plays = plays.filter(F.col(column).isin(*wanted))
    if ydstogo is not None:
        plays = plays.filter(F.col("ydstogo").between(*ydstogo))
    for column, wanted in {"interception": interception, "fumble": fumble}.items():
        if wanted is not None:
            plays = plays.filter(F.col(column) == int(wanted))
    return plays
