from oracle.relations import query, rounded

SIX_HOURS = "INTERVAL 6 HOUR"


def avg(expression: str, digits: int) -> str:
    return rounded(f"avg({expression})", digits)


def bias(least: int) -> str:
    return f"""bias AS (
    SELECT target_team, count(*) AS num_games,
           {avg('price', 3)} AS avg_market_prob,
           {avg('won', 3)} AS actual_win_rate,
           {avg('price - won', 3)} AS avg_signed_error
    FROM played WHERE winner IS NOT NULL
    GROUP BY target_team HAVING count(*) >= {least}
)"""


BIAS = bias(5)

SWINGS = f"""top_swings AS (
    SELECT game_id, home_team, away_team, target_team,
           {rounded('lo', 3)} AS min_price, {rounded('hi', 3)} AS max_price,
           {rounded('hi - lo', 3)} AS price_swing
    FROM (
        SELECT m.market_ticker, m.game_id, m.target_team, g.home_team, g.away_team,
               min(p.kalshi_close) AS lo, max(p.kalshi_close) AS hi
        FROM prices p JOIN markets m USING (market_ticker) JOIN games g USING (game_id)
        WHERE p.datetime_utc >= g.game_date::TIMESTAMP AND p.kalshi_close > 0
        GROUP BY ALL)
    ORDER BY hi - lo DESC, game_id, market_ticker LIMIT 20
)"""

ADVERSITY = f"""adversity AS (
    SELECT fell::INTEGER AS experienced_major_adversity, count(*) AS num_games,
           {avg('price', 3)} AS avg_pregame_prob, {avg('won', 3)} AS favorite_win_rate
    FROM (
        SELECT f.game_id, f.price, f.won,
               min(if(f.target_team = g.home_team, p.vegas_wp, 1 - p.vegas_wp))
                 <= any_value(if(f.target_team = g.home_team, k.home_vegas_wp, 1 - k.home_vegas_wp)) - 0.25::DOUBLE
                 AS fell
        FROM played f
        JOIN games g USING (game_id) JOIN kickoffs k USING (game_id) JOIN plays p USING (game_id)
        WHERE f.price >= 0.65 AND f.winner IS NOT NULL AND p.vegas_wp IS NOT NULL
          AND NOT (p.qtr = 4 AND p.quarter_seconds_remaining < 120)
        GROUP BY f.game_id, f.target_team, f.price, f.won)
    GROUP BY fell
)"""

WEEKS = f"""weeks AS (
    SELECT week, count(*) AS numberoffgames, {avg('price', 2)} AS avg_predicted,
           {avg('won', 2)} AS actual, {avg('abs(price - won)', 2)} AS error
    FROM played WHERE week BETWEEN 1 AND 18 GROUP BY week
)"""

VOLATILITY = f"""volatility AS (
    SELECT if(price_swing >= 0.97, 'high_volatility', 'low_volatility') AS volatility_group,
           count(*) AS numberofgames, {avg('price', 3)} AS avg_predicted_prob,
           {avg('won', 3)} AS actual_win_rate, {avg('abs(price - won)', 3)} AS avg_error
    FROM played JOIN swings USING (game_id) GROUP BY ALL
)"""

CALIBRATION = f"""calibration AS (
    -- Fixed values: the names of the bands.
    SELECT CASE WHEN price >= 0.8 THEN 'strong_favorite' WHEN price >= 0.6 THEN 'moderate_favorite'
                ELSE 'slight_favorite' END AS favorite_strength,
           count(*) AS num_games, {avg('price', 2)} AS avg_predicted, {avg('won', 2)} AS actual_win_rate
    FROM played WHERE price >= 0.5 GROUP BY ALL
)"""

HISTORY = """history AS (
    SELECT p.market_ticker, m.target_team, p.* EXCLUDE (market_ticker)
    FROM prices p JOIN markets m USING (market_ticker) WHERE m.target_team = 'T01'
    ORDER BY p.datetime_utc DESC, p.market_ticker LIMIT {limit}
)"""

FADES = f"""traded AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY market_ticker) AS n
    FROM prices WHERE kalshi_close > 0
    WINDOW w AS (PARTITION BY market_ticker ORDER BY datetime_utc)
),
fades AS (
    SELECT market_ticker, target_team, first_window_volume, total_volume,
           {rounded('first_window_volume / nullif(total_volume, 0)', 3)} AS early_volume_share,
           {rounded('early', 3)} AS early_price, {rounded('late', 3)} AS late_price,
           {rounded('late - early', 3)} AS price_change, num_candles
    FROM (
        SELECT market_ticker, max(n) AS num_candles,
               coalesce(sum(kalshi_volume) FILTER (i <= 5), 0)::BIGINT AS first_window_volume,
               sum(kalshi_volume)::BIGINT AS total_volume,
               avg(kalshi_close) FILTER (i <= 5) AS early,
               avg(kalshi_close) FILTER (i > n - 5) AS late
        FROM traded GROUP BY market_ticker)
    JOIN markets USING (market_ticker)
    WHERE num_candles >= 10 AND CAST(early - late AS DECIMAL(18, 10)) >= 0.1
)"""

COVERAGE = """coverage AS (
    SELECT count(*) AS total_games,
           count(*) FILTER (has_market) AS games_with_kalshi,
           count(*) FILTER (NOT has_market) AS games_without_kalshi,
           count(*) FILTER (has_plays) AS games_with_plays,
           count(*) FILTER (has_market AND has_plays) AS games_with_complete_data
    FROM (SELECT game_id IN (SELECT game_id FROM markets) AS has_market,
                 game_id IN (SELECT game_id FROM plays) AS has_plays
          FROM games)
)"""

VEGAS = f"""vegas AS (
    SELECT week, count(*) AS num_games, {avg('price', 3)} AS avg_kalshi_prob,
           {avg('model', 3)} AS avg_vegas_wp, {avg('price - model', 3)} AS avg_diff
    FROM (
        SELECT g.week, r.kalshi_close AS price,
               CASE r.target_team WHEN g.home_team THEN k.home_vegas_wp
                                  WHEN g.away_team THEN 1 - k.home_vegas_wp END AS model
        FROM ranked r JOIN games g USING (game_id) JOIN kickoffs k USING (game_id)
        WHERE r.rn = 1 AND g.week BETWEEN 1 AND 18)
    WHERE model IS NOT NULL GROUP BY week
)"""


def scores(name: str, play_filter: str, min_obs: int) -> str:
    return f"""{name} AS (
    SELECT score_diff, count(*) AS num_observations,
           {avg('price', 3)} AS avg_kalshi_home_price, {avg('vegas_wp', 3)} AS avg_vegas_wp
    FROM (
        SELECT s.score_diff, s.vegas_wp, c.kalshi_close AS price
        FROM (
            SELECT m.market_ticker, p.timestamp_utc - INTERVAL 5 HOUR AS at, p.vegas_wp,
                   p.total_home_score - p.total_away_score AS score_diff
            FROM plays p JOIN games g USING (game_id)
            JOIN markets m ON m.game_id = p.game_id AND m.target_team = g.home_team
            WHERE p.timestamp_utc IS NOT NULL AND p.vegas_wp IS NOT NULL
              AND p.qtr BETWEEN 1 AND 4 AND {play_filter}) s
        ASOF JOIN prices c ON c.market_ticker = s.market_ticker AND c.datetime_utc <= s.at
        WHERE c.datetime_utc >= s.at - {SIX_HOURS})
    GROUP BY score_diff HAVING count(*) >= {min_obs}
)"""


SCORES = scores("scores", "TRUE", 3)

EARLY_DOWNS = scores(
    "early_downs",
    "p.qtr <= 3 AND p.down <= 2 AND p.ydstogo BETWEEN 2 AND 9"
    " AND p.interception = 0 AND p.fumble = 0",
    1,
)

ORACLES = {
    "pregame_prices": query("SELECT market_ticker, game_id, target_team, kalshi_close, rn FROM ranked"),
    "game_results": query("SELECT game_id, winner FROM results"),
    "game_volatility": query("SELECT * FROM swings"),
    "favorite_summary": query(
        "SELECT game_id, target_team AS favorite_team, price AS favorite_prob,"
        " won AS favorite_won FROM played"
    ),
    "first_play_wp": query("SELECT * FROM kickoffs"),
    "market_bias": query("FROM bias ORDER BY avg_signed_error DESC, target_team", BIAS),
    "market_bias_from_facts": query("FROM bias", BIAS),
    "market_bias_from_increments": query("FROM bias", BIAS),
    "results_from_increments": query("SELECT game_id, winner FROM results"),
    "published_views": query(
        "SELECT p.game_id, p.target_team AS favorite_team, p.price AS favorite_prob,"
        " s.price_swing, r.market_ticker"
        " FROM played p JOIN swings s USING (game_id) JOIN ranked r USING (game_id)"
        " WHERE r.rn = 1 AND p.price >= 0.5 AND p.won = 1"
    ),
    "market_swings": query("FROM top_swings", SWINGS),
    "adversity_performance": query("FROM adversity ORDER BY 1", ADVERSITY),
    "accuracy_by_week": query("FROM weeks ORDER BY week", WEEKS),
    "volatility_comparison": query("FROM volatility", VOLATILITY),
    "underdog_win_rate": query(
        "SELECT count(*) AS total_underdog_games, sum(won) AS underdog_wins,"
        f" {avg('won', 3)} AS underdog_win_rate FROM played WHERE price <= 0.4"
    ),
    "favorite_win_rate": query(
        "SELECT count(*) AS total_games, coalesce(sum(won), 0) AS favorite_wins,"
        f" coalesce({avg('won', 3)}, 0) AS favorite_win_rate FROM played WHERE price >= 0.5"
    ),
    "favorite_calibration": query("FROM calibration ORDER BY 1", CALIBRATION),
    "team_market_history": query("FROM history", HISTORY.format(limit=500)),
    "team_market_history_50": query("FROM history", HISTORY.format(limit=50)),
    "early_hype_fade": query("FROM fades ORDER BY price_change, early_price DESC", FADES),
    "game_coverage": query("FROM coverage", COVERAGE),
    "vegas_vs_market": query("FROM vegas ORDER BY week", VEGAS),
    "score_vs_market": query("FROM scores ORDER BY score_diff", SCORES),
    "timestamp_overlap": query(
        """SELECT
    (SELECT count(timestamp_utc) FROM plays) AS plays_with_ts,
    (SELECT count(*) FROM plays) AS plays_total,
    (SELECT min(timestamp_utc) FROM plays) AS plays_ts_min,
    (SELECT max(timestamp_utc) FROM plays) AS plays_ts_max,
    (SELECT min(datetime_utc) FROM prices) AS kalshi_ts_min,
    (SELECT max(datetime_utc) FROM prices) AS kalshi_ts_max,
    (SELECT count(DISTINCT p.game_id)
       FROM plays p JOIN markets m USING (game_id) JOIN prices c USING (market_ticker)
      WHERE abs(epoch_us(c.datetime_utc + INTERVAL 5 HOUR) - epoch_us(p.timestamp_utc)) <= 600000000
    ) AS games_with_ts_overlap"""
    ),
    "filter_plays": query("FROM early_downs", EARLY_DOWNS),
    "filter_plays_with_facts": query(
        """SELECT game_id, CASE WHEN hs > aw THEN home_team WHEN aw > hs THEN away_team END AS winner
FROM (SELECT DISTINCT ON (game_id) game_id, total_home_score AS hs, total_away_score AS aw
      FROM plays WHERE qtr = 1
      ORDER BY game_id, quarter_seconds_remaining, play_id DESC)
JOIN games USING (game_id)"""
    ),
    "overlap_by_day": query(
        """SELECT CAST(p.timestamp_utc AS DATE) AS day, count(DISTINCT p.game_id) AS games_with_ts_overlap
  FROM plays p JOIN markets m USING (game_id) JOIN prices c USING (market_ticker)
 WHERE abs(epoch_us(c.datetime_utc + INTERVAL 5 HOUR) - epoch_us(p.timestamp_utc)) <= 600000000
 GROUP BY GROUPING SETS ((CAST(p.timestamp_utc AS DATE)), ())"""
    ),
}

# The table functions return what the reports do.
ORACLES |= {
    f"sql_{name}": ORACLES[name]
    for name in (
        "market_bias",
        "market_swings",
        "underdog_win_rate",
        "favorite_win_rate",
        "early_hype_fade",
    )
}
