"""The parameterised reports as SQL table functions: ``SELECT * FROM market_bias(5)``.

Parameters are bound by Spark as values of their types. The bodies read published views;
what does not depend on a parameter is the same plan as in ``reports``.
"""

from __future__ import annotations

from fourthtick.plans import reports, views
from fourthtick.tables import Tables


def _rounded(value: str, digits: int) -> str:
    """``functions.rounding`` in SQL: half up, through decimals."""
    return f"CAST(round(CAST({value} AS DECIMAL(18, 10)), {digits}) AS DOUBLE)"


# Name -> (parameters, result columns, body). ``{p}`` is the prefix of the published views.
FUNCTIONS = {
    "market_bias": (
        "min_games INT DEFAULT 5",
        "target_team STRING, num_games BIGINT, avg_market_prob DOUBLE, actual_win_rate DOUBLE, "
        "avg_signed_error DOUBLE",
        f"""SELECT target_team, count(*), {_rounded("avg(kalshi_close)", 3)}, {_rounded("avg(won)", 3)},
                   {_rounded("avg(kalshi_close - won)", 3)}
            FROM {{p}}outcomes WHERE winner IS NOT NULL
            GROUP BY target_team HAVING count(*) >= min_games""",
    ),
    "market_swings": (
        "top INT DEFAULT 20",
        "game_id STRING, home_team STRING, away_team STRING, target_team STRING, min_price DOUBLE, "
        "max_price DOUBLE, price_swing DOUBLE",
        """SELECT game_id, home_team, away_team, target_team, min_price, max_price, price_swing
           FROM (SELECT *, row_number() OVER (ORDER BY swing DESC, game_id, market_ticker) AS place
                 FROM {p}swings) WHERE place <= top""",
    ),
    "underdog_win_rate": (
        "max_prob DOUBLE DEFAULT 0.4D",
        "total_underdog_games BIGINT, underdog_wins DOUBLE, underdog_win_rate DOUBLE",
        f"""SELECT count(*), sum(won), {_rounded("avg(won)", 3)}
            FROM {{p}}outcomes WHERE kalshi_close <= max_prob""",
    ),
    "favorite_win_rate": (
        "min_prob DOUBLE DEFAULT 0.5D",
        "total_games BIGINT, favorite_wins DOUBLE, favorite_win_rate DOUBLE",
        f"""SELECT count(*), coalesce(sum(won), 0D), coalesce({_rounded("avg(won)", 3)}, 0D)
            FROM {{p}}outcomes WHERE kalshi_close >= min_prob""",
    ),
    "early_hype_fade": (
        "min_price_drop DOUBLE DEFAULT 0.3D, window_size INT DEFAULT 5",
        "market_ticker STRING, target_team STRING, first_window_volume BIGINT, total_volume BIGINT, "
        "early_volume_share DOUBLE, early_price DOUBLE, late_price DOUBLE, price_change DOUBLE, "
        "num_candles BIGINT",
        f"""WITH first_of_parts AS (
                SELECT *, row_number() OVER (PARTITION BY market_ticker, part ORDER BY datetime_utc) AS k
                FROM {{p}}traded
            ), early AS (
                SELECT market_ticker, coalesce(sum(kalshi_volume), 0) AS volume, avg(kalshi_close) AS price
                FROM (SELECT *, row_number() OVER (PARTITION BY market_ticker ORDER BY datetime_utc) AS n
                      FROM first_of_parts WHERE k <= window_size)
                WHERE n <= window_size GROUP BY market_ticker
            ), last_of_parts AS (
                SELECT *, row_number() OVER (PARTITION BY market_ticker, part ORDER BY datetime_utc DESC) AS k
                FROM {{p}}traded
            ), late AS (
                SELECT market_ticker, avg(kalshi_close) AS price
                FROM (SELECT *, row_number() OVER (PARTITION BY market_ticker ORDER BY datetime_utc DESC) AS n
                      FROM last_of_parts WHERE k <= window_size)
                WHERE n <= window_size GROUP BY market_ticker
            ), totals AS (
                SELECT market_ticker, count(*) AS candles, sum(kalshi_volume) AS volume
                FROM {{p}}traded GROUP BY market_ticker
            )
            SELECT m.market_ticker, m.target_team, e.volume, t.volume,
                   {_rounded("e.volume / nullif(t.volume, 0)", 3)}, {_rounded("e.price", 3)},
                   {_rounded("l.price", 3)}, {_rounded("l.price - e.price", 3)}, t.candles
            FROM totals t JOIN early e USING (market_ticker) JOIN late l USING (market_ticker)
                 JOIN {{p}}kalshi_markets m USING (market_ticker)
            WHERE t.candles >= 2 * window_size
              AND CAST(e.price - l.price AS DECIMAL(18, 10)) >= CAST(min_price_drop AS DECIMAL(18, 10))""",
    ),
}


def publish_functions(t: Tables, prefix: str = "") -> None:
    """Register the tables and views, and the reports above as temporary table functions."""
    views.publish_views(t, prefix)
    views.outcomes(t).createOrReplaceTempView(prefix + "outcomes")
    reports.swings(t).createOrReplaceTempView(prefix + "swings")
    reports.traded_parts(t).createOrReplaceTempView(prefix + "traded")
    for name, (parameters, columns, body) in FUNCTIONS.items():
        t.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) "
            f"RETURNS TABLE({columns}) RETURN {body.format(p=prefix)}"
        )
