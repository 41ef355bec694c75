"""The five relations of FIXTURES.md as DuckDB common table expressions."""

RELATIONS = """
teams AS (
    SELECT 'T' || lpad(n_nationkey::VARCHAR, 2, '0') AS team_abbr, n_name AS team_name FROM nation
),
users AS (
    SELECT u,
           'T' || lpad((u % 25)::VARCHAR, 2, '0') AS home,
           'T' || lpad(((u % 25 + 1 + (u // 25) % 24) % 25)::VARCHAR, 2, '0') AS away
    FROM (SELECT DISTINCT user_id AS u FROM events)
),
games AS (
    SELECT 'G' || u AS game_id, 2024::INTEGER AS season, (1 + u % 20)::INTEGER AS week,
           DATE '2024-01-01' + (u % 10)::INTEGER AS game_date, home AS home_team, away AS away_team
    FROM users
),
markets AS (
    SELECT 'MK-' || u AS market_ticker, 'G' || u AS game_id,
           CASE u % 3 WHEN 0 THEN away ELSE home END AS target_team,
           home || ' win' AS market_title
    FROM users WHERE u % 10 <> 9
),
raw_candles AS (
    SELECT user_id AS u, event_id AS e, ts,
           CASE WHEN event_id % 23 = 0 THEN 0 ELSE (1 + (53 * event_id + 7 * user_id) % 99) / 100.0::DOUBLE END AS o,
           CASE WHEN event_id % 23 = 0 THEN 0 ELSE (1 + (37 * event_id + 11 * user_id) % 99) / 100.0::DOUBLE END AS c
    FROM events
    WHERE event_type NOT IN ('signup', 'error') AND user_id % 10 <> 9
),
prices AS (
    SELECT 'MK-' || u AS market_ticker, ts - INTERVAL 5 HOUR AS datetime_utc,
           o AS kalshi_open, greatest(o, c) AS kalshi_high, least(o, c) AS kalshi_low,
           c AS kalshi_close, (e % 50)::INTEGER AS kalshi_volume
    FROM raw_candles
),
raw_plays AS (
    SELECT user_id AS u, event_id AS e, ts, event_type, props,
           (7 * event_id % 11 * 3)::INTEGER AS home_points,
           ((5 * event_id + user_id) % 11 * 3)::INTEGER AS away_points
    FROM events
    WHERE event_type IN ('signup', 'error') AND user_id % 14 <> 13
),
plays AS (
    SELECT 'G' || u AS game_id, e::INTEGER AS play_id,
           (1 + (day(ts) - 1) // 7)::INTEGER AS qtr,
           (900 - 31 * e % 900)::DOUBLE AS quarter_seconds_remaining,
           CASE WHEN e % 19 > 0 THEN (1 + e % 4)::INTEGER END AS down,
           (1 + e % 10)::INTEGER AS ydstogo,
           event_type AS play_type, props AS description,
           home_points AS total_home_score, away_points AS total_away_score,
           (home_points - away_points + 40) / 80.0::DOUBLE AS wp,
           CASE WHEN e % 17 > 0 THEN (home_points - away_points + 40) / 80.0::DOUBLE END AS vegas_wp,
           (e % 29 = 0)::INTEGER AS interception, (e % 31 = 0)::INTEGER AS fumble,
           (e % 37 = 0)::INTEGER AS touchdown,
           CASE WHEN e % 13 > 0 THEN ts END AS timestamp_utc
    FROM raw_plays
)"""

VIEWS = """,
ranked AS (
    SELECT m.*, p.kalshi_close,
           row_number() OVER (PARTITION BY m.market_ticker ORDER BY p.datetime_utc) AS rn
    FROM prices p JOIN markets m USING (market_ticker)
    WHERE p.kalshi_close > 0
),
last_plays AS (
    SELECT * FROM plays
    QUALIFY row_number() OVER (
        PARTITION BY game_id
        ORDER BY qtr DESC NULLS FIRST, quarter_seconds_remaining ASC NULLS LAST,
                 play_id DESC NULLS FIRST) = 1
),
results AS (
    SELECT game_id, week,
           CASE sign(total_home_score - total_away_score)
               WHEN 1 THEN home_team WHEN -1 THEN away_team END AS winner
    FROM last_plays JOIN games USING (game_id)
),
swings AS (
    SELECT game_id, max(kalshi_close) - min(kalshi_close) AS price_swing
    FROM prices JOIN markets USING (market_ticker) GROUP BY game_id
),
kickoffs AS (
    SELECT game_id, vegas_wp AS home_vegas_wp FROM plays WHERE vegas_wp IS NOT NULL
    QUALIFY row_number() OVER (
        PARTITION BY game_id
        ORDER BY qtr ASC NULLS LAST, quarter_seconds_remaining DESC NULLS FIRST,
                 play_id ASC NULLS LAST) = 1
),
played AS (
    SELECT r.game_id, r.target_team, r.kalshi_close AS price, g.week, g.winner,
           coalesce(g.winner = r.target_team, FALSE)::INTEGER::DOUBLE AS won
    FROM ranked r JOIN results g USING (game_id)
    WHERE r.rn = 1
)"""


def query(body: str, *more: str) -> str:
    """A full statement: relations, views, further CTEs, then the body."""
    return "WITH " + RELATIONS + VIEWS + "".join(f",\n{cte}" for cte in more) + "\n" + body


def rounded(expression: str, digits: int) -> str:
    """Round half away from zero through a decimal."""
    return f"round(CAST({expression} AS DECIMAL(18, 10)), {digits})::DOUBLE"
