"""Figures and labels derived from the reports."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourthtick.functions.rounding import percent, round_half_up
from fourthtick.functions.text import classify, signed_class, title_from_snake
from fourthtick.plans import reports
from fourthtick.tables import Tables


def summary_cards(
    t: Tables, favorite_threshold: float = 0.5, volatility_threshold: float = 0.5
) -> DataFrame:
    """Headline figures in one row: favorites, underdogs, volatile games, weekly error.

    A threshold of 0 means the default of 0.5. The underdog limit mirrors the
    favorite threshold, rounded to two digits. Weeks weigh the same in the weekly
    error. A rate without games shows 0, an accuracy without volatile games is NULL.

    All four figures come out of one pass: sums per game, then per week, then overall.
    """
    min_prob = favorite_threshold or 0.5
    max_prob = float(Decimal(1 - min_prob).quantize(Decimal("0.01"), ROUND_HALF_UP))
    wide = F.col("price_swing") >= (volatility_threshold or 0.5)
    sums = ["favorites", "favorites_won", "underdogs", "underdogs_won"]
    weekly = (
        reports.game_totals(
            t, favorites=F.col("price") >= min_prob, underdogs=F.col("price") <= max_prob
        )
        .groupBy("week")
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            F.sum(F.when(wide, F.col("n"))).alias("wide_n"),
            F.sum(F.when(wide, F.col("error"))).alias("wide_error"),
            round_half_up(F.sum("error") / F.sum("n"), 2).alias("error"),
        )
    )

    def count(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    def rate(name: str) -> Column:
        share = round_half_up(F.sum(f"{name}_won") / F.nullif(F.sum(name), F.lit(0)), 3)
        return percent(F.coalesce(share, F.lit(0.0)))

    wide_error = round_half_up(F.sum("wide_error") / F.sum("wide_n"), 3)
    return weekly.agg(
        rate("favorites").alias("favorite_win_rate_pct"),
        count("favorites").alias("favorite_games"),
        rate("underdogs").alias("underdog_win_rate_pct"),
        count("underdogs").alias("underdog_games"),
        percent(1 - wide_error).alias("high_volatility_accuracy_pct"),
        round_half_up(F.avg(F.when(F.expr(reports.REGULAR_SEASON), F.col("error"))), 3).alias(
            "avg_weekly_error"
        ),
    )


def coverage_pct(t: Tables) -> DataFrame:
    """The coverage counts with the share of games that have a market, in percent."""
    share = F.col("games_with_kalshi") / F.nullif(F.col("total_games"), F.lit(0))
    return reports.game_coverage(t).withColumn("coverage_pct", percent(share))


def calibration_gap(t: Tables) -> DataFrame:
    """Actual minus predicted win rate per band of favorites."""
    gap = round_half_up(F.col("actual_win_rate") - F.col("avg_predicted"), 3)
    return (
        reports.favorite_calibration(t)
        .withColumn("display_name", title_from_snake(F.col("favorite_strength")))
        .withColumn("gap", gap)
        .withColumn("well_calibrated", F.abs("gap") < 0.05)
    )


def swing_severity(t: Tables, limit: int = 20) -> DataFrame:
    """The widest swings, each with its class."""
    severity = classify(F.col("price_swing"), [(0.2, "high"), (0.1, "medium")], "low")
    return reports.market_swings(t, limit).withColumn("severity", severity)


def bias_class(t: Tables, min_games: int = 5) -> DataFrame:
    """Team bias, classed as over- or underestimated by the market."""
    label = signed_class(
        F.col("avg_signed_error"), 0.05, "overestimated", "underestimated", "neutral"
    )
    return reports.market_bias(t, min_games).withColumn("bias_class", label)


def bias_top20(t: Tables, min_games: int = 5, limit: int = 20) -> DataFrame:
    """The ``limit`` most overestimated teams."""
    return reports.market_bias(t, min_games).limit(limit)


def fade_severity(t: Tables, min_price_drop: float = 0.3, window_size: int = 5) -> DataFrame:
    """Fading markets with the size of the drop and its class."""
    severity = classify(F.col("price_drop"), [(0.3, "high"), (0.15, "medium")], "low")
    return (
        reports.early_hype_fade(t, min_price_drop, window_size)
        .withColumn("price_drop", F.abs("price_change"))
        .withColumn("severity", severity)
    )


def fade_top20(
    t: Tables, min_price_drop: float = 0.3, window_size: int = 5, limit: int = 20
) -> DataFrame:
    """The ``limit`` largest drops."""
    return (
        reports.early_hype_fade(t, min_price_drop, window_size)
        .limit(limit)
        .select(
            "market_ticker",
            F.col("target_team").alias("label"),
            F.abs("price_change").alias("price_drop"),
            "early_price",
            "late_price",
        )
    )


def vegas_season_summary(t: Tables) -> DataFrame:
    """Number of weeks and the means over weeks, each week counting once."""
    return reports.vegas_vs_market(t).agg(
        F.count("*").alias("weeks_analyzed"),
        percent(F.avg("avg_kalshi_prob")).alias("avg_kalshi_prob_pct"),
        percent(F.avg("avg_vegas_wp")).alias("avg_vegas_wp_pct"),
        # Without any week the mean difference shows as 0.
        F.coalesce(percent(F.avg("avg_diff")), F.lit(0.0)).alias("avg_diff_pct"),
    )


def vegas_week_class(t: Tables) -> DataFrame:
    """Each week's difference between market and model, with its class."""
    label = signed_class(
        F.col("avg_diff"), 0.03, "market_higher", "market_lower", "close"
    )
    return (
        reports.vegas_vs_market(t)
        .withColumn("week_label", week_label(F.col("week")))
        .withColumn("diff_class", label)
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Totals over the rows of ``score_vs_market``."""
    diff = F.col("score_diff")
    return scores.agg(
        F.count("*").alias("score_bands"),
        F.coalesce(F.sum("num_observations"), F.lit(0)).alias("total_observations"),
        percent(F.max(F.when(diff == 0, F.col("avg_kalshi_home_price")))).alias(
            "tied_home_price_pct"
        ),
        F.min(diff).alias("min_diff"),
        F.max(diff).alias("max_diff"),
    )


def history_rows(t: Tables, team: str, limit: int = 100) -> DataFrame:
    """The newest candles of a team's markets, with date and time as text."""
    at = F.col("datetime_utc").cast("string")
    return reports.team_market_history(t, team, limit).select(
        F.substring(at, 1, 10).alias("date"),
        F.substring(at, 12, 8).alias("time"),
        F.col("market_ticker").alias("ticker"),
        F.col("kalshi_open").alias("open"),
        F.col("kalshi_high").alias("high"),
        F.col("kalshi_low").alias("low"),
        F.col("kalshi_close").alias("close"),
        F.col("kalshi_volume").alias("volume"),
    )


def adversity_label(
    t: Tables, favorite_threshold: float = 0.65, adversity_drop: float = 0.25
) -> DataFrame:
    """The adversity report with readable groups and whether favorites met their price."""
    group = F.when(F.col("experienced_major_adversity") == 1, "Faced Adversity").otherwise(
        "No Major Adversity"
    )
    return (
        reports.adversity_performance(t, favorite_threshold, adversity_drop)
        .withColumn("group_label", group)
        .withColumn("met_price", F.col("favorite_win_rate") >= F.col("avg_pregame_prob"))
    )


def week_label(week: Column) -> Column:
    return F.concat(F.lit("W"), week.cast("string"))


def accuracy_with_week_label(t: Tables) -> DataFrame:
    """Accuracy per week, labelled ``W1``, ``W2``, ..."""
    return reports.accuracy_by_week(t).withColumn("week_label", week_label(F.col("week")))
