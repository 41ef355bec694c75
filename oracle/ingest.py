from oracle.relations import query

# What the ingest of the raw shapes has to give back, stated on the relations.

TICKERS = """coded AS (
    SELECT u, 'G' || u AS game_id, home, away, DATE '2024-01-01' + (u % 10)::INTEGER AS day,
           CASE home WHEN 'T03' THEN 'X03' WHEN 'T11' THEN 'X11' ELSE home END AS mhome,
           CASE away WHEN 'T03' THEN 'X03' WHEN 'T11' THEN 'X11' ELSE away END AS maway
    FROM users
),
tickers AS (
    SELECT *, 'GAME-' || upper(strftime(day, '%y%b%d')) AS today,
           'GAME-' || upper(strftime(day + 1, '%y%b%d')) AS tomorrow
    FROM coded
),
tries AS (
    SELECT *, CASE
        WHEN u = 7 THEN ['EV-SPECIAL']
        WHEN home = mhome AND away = maway THEN [today || away || home, tomorrow || away || home]
        ELSE [today || away || home, today || maway || mhome,
              tomorrow || away || home, tomorrow || maway || mhome] END AS list
    FROM tickers
),
landed AS (
    SELECT u, home, away, CASE WHEN u % 3 = 0 THEN maway ELSE mhome END AS code,
           CASE WHEN u = 7 THEN 'EV-SPECIAL'
                ELSE if(u % 2 = 0, today, tomorrow)
                     || if(u % 4 < 2, away || home, maway || mhome) END AS event_ticker
    FROM tickers WHERE u % 10 <> 9
),
found AS (
    SELECT t.game_id, t.u, min_by(l.event_ticker, list_position(t.list, l.event_ticker)) AS event_ticker
    FROM tries t JOIN landed l ON list_contains(t.list, l.event_ticker)
    WHERE l.u % 20 <> 6
    GROUP BY t.game_id, t.u
),
winners AS (
    SELECT DISTINCT f.game_id, f.event_ticker, f.event_ticker || '-' || l.code AS market_ticker,
           l.home || ' Win' AS market_title,
           '2024-01-' || (10 + l.u % 10) || 'T06:00:00Z' AS close_time,
           CASE l.code WHEN 'X03' THEN 'T03' WHEN 'X11' THEN 'T11' ELSE l.code END AS target_team
    FROM found f JOIN landed l USING (event_ticker) WHERE l.u % 20 NOT IN (4, 6)
)"""

# The candles that landed pages give, one per market and second.
SECONDS = """seconds AS (
    SELECT u, date_trunc('second', ts) AS s, o, c, (e % 50)::INTEGER AS v FROM raw_candles
    QUALIFY row_number() OVER (
        PARTITION BY u, date_trunc('second', ts)
        ORDER BY v DESC, c DESC, greatest(o, c) DESC, least(o, c) DESC, o DESC) = 1
)"""

WINDOWED = """
    s - INTERVAL 5 HOUR AS datetime_utc, o AS kalshi_open, greatest(o, c) AS kalshi_high,
    least(o, c) AS kalshi_low, c AS kalshi_close, v AS kalshi_volume
FROM seconds JOIN landed l USING (u)
WHERE l.event_ticker || '-' || l.code IN (
        -- Only games of the play-by-play are resolved.
        SELECT market_ticker FROM winners WHERE game_id IN (SELECT game_id FROM plays))
  AND s BETWEEN make_timestamp(2024, 1, 10 + u % 10, 2, 0, 0)
            AND make_timestamp(2024, 1, 10 + u % 10, 6, 0, 0)"""

INGESTED_PRICES = "SELECT l.event_ticker || '-' || l.code AS market_ticker," + WINDOWED

PLAYED = "game_id IN (SELECT game_id FROM plays)"

# Tables with damage, as the fixture does it.
DAMAGE = """bad_teams AS (
    SELECT team_abbr, CASE team_abbr WHEN 'T02' THEN NULL ELSE team_name END AS team_name
    FROM teams WHERE team_abbr <> 'T05'
    UNION ALL FROM teams WHERE team_abbr = 'T03'
),
bad_games AS (
    SELECT CASE week WHEN 8 THEN NULL ELSE game_id END AS game_id, home_team, away_team
    FROM games WHERE week <> 9
),
bad_plays AS (
    SELECT game_id, play_id FROM plays, range(if(play_id % 50 = 3, 3, 1))
),
bad_markets AS (FROM markets WHERE market_ticker[-1] <> '3'),
bad_prices AS (
    SELECT market_ticker, datetime_utc FROM prices, range(if(kalshi_volume = 7, 2, 1))
)"""


def bad_keys(table: str, *columns: str) -> str:
    names = ", ".join(columns)
    missing = " OR ".join(f"{c} IS NULL" for c in columns)
    return f"""SELECT '{table}' AS table_name, '{names}' AS columns, 'primary key' AS rule,
    count(*) AS violations
FROM (SELECT 1 FROM bad_{table.replace('kalshi_', '')} GROUP BY {names}
      HAVING count(*) > 1 OR bool_or({missing}))"""


REFERENCES = [
    ("games", "home_team", "teams", "team_abbr"),
    ("games", "away_team", "teams", "team_abbr"),
    ("plays", "game_id", "games", "game_id"),
    ("kalshi_markets", "game_id", "games", "game_id"),
    ("kalshi_markets", "target_team", "teams", "team_abbr"),
    ("kalshi_prices", "market_ticker", "kalshi_markets", "market_ticker"),
]


def orphans(prefix: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table,
    count(DISTINCT {column}) AS orphan_keys, count({column}) AS orphan_rows
FROM {prefix}{child.replace('kalshi_', '')} c
WHERE NOT EXISTS (FROM {prefix}{parent.replace('kalshi_', '')} p WHERE p.{key} = c.{column})"""
        for child, column, parent, key in REFERENCES
    )


ORACLES = {
    "build_games": query("FROM games WHERE game_id IN (SELECT game_id FROM plays)"),
    "build_plays": query("FROM plays WHERE timestamp_utc IS NOT NULL"),
    "build_teams": query(
        """SELECT code AS team_abbr,
    if(code < 'T20', 'Team ' || code[2:]::INTEGER, code) AS team_name
FROM (SELECT home_team AS code FROM games UNION SELECT away_team FROM games)"""
    ),
    "event_ticker_candidates": query(
        """SELECT game_id, (i - 1)::INTEGER AS pos, list[i] AS ticker
FROM tries, range(1, 5) AS r(i) WHERE i <= len(list)""",
        TICKERS,
    ),
    "resolve_event_ticker": query("SELECT game_id, event_ticker FROM found", TICKERS),
    "select_winner_market": query(
        "SELECT game_id, event_ticker, market_ticker, market_title, close_time FROM winners", TICKERS
    ),
    "market_target_team": query(
        "SELECT market_ticker, game_id, target_team, market_title FROM winners", TICKERS
    ),
    "flatten_candles": query(
        """SELECT 'MK-' || u AS market_ticker, date_trunc('second', ts) - INTERVAL 5 HOUR AS datetime_utc,
    o AS kalshi_open, greatest(o, c) AS kalshi_high, least(o, c) AS kalshi_low, c AS kalshi_close,
    (e % 50)::INTEGER AS kalshi_volume, epoch_us(ts) // 1000000 AS end_period_ts
FROM raw_candles"""
    ),
    "candle_window": query(
        """SELECT 'MK-' || u AS market_ticker, date_trunc('second', ts) - INTERVAL 5 HOUR AS datetime_utc,
    o AS kalshi_open, greatest(o, c) AS kalshi_high, least(o, c) AS kalshi_low, c AS kalshi_close,
    (e % 50)::INTEGER AS kalshi_volume
FROM raw_candles
WHERE date_trunc('second', ts) BETWEEN make_timestamp(2024, 1, 10 + u % 10, 2, 0, 0)
                                   AND make_timestamp(2024, 1, 10 + u % 10, 6, 0, 0)"""
    ),
    "incremental_new_games": query(
        """FROM games WHERE game_id IN ('G1', 'G2')
    OR game_id NOT IN (SELECT game_id FROM markets)"""
    ),
    "append_dedup_markets": query("FROM markets"),
    "append_dedup_prices": query("FROM prices"),
    "failed_games_report": query(
        """SELECT t.game_id,
    if(f.game_id IS NULL, 'no markets found', 'no winner market') AS reason,
    coalesce(f.event_ticker, array_to_string(t.list, ', ')) AS tried
FROM tries t LEFT JOIN found f USING (game_id)
WHERE t.game_id NOT IN (SELECT game_id FROM winners)""",
        TICKERS,
    ),
    "build_tables": query(INGESTED_PRICES, TICKERS, SECONDS),
    "build_tables_games": query(f"FROM games WHERE {PLAYED}"),
    "build_tables_plays": query("FROM plays WHERE timestamp_utc IS NOT NULL"),
    "build_tables_teams": query(
        f"""SELECT code AS team_abbr,
    if(code < 'T20', 'Team ' || code[2:]::INTEGER, code) AS team_name
FROM (SELECT home_team AS code FROM games WHERE {PLAYED}
      UNION SELECT away_team FROM games WHERE {PLAYED})"""
    ),
    "build_tables_markets": query(
        f"""SELECT DISTINCT ON (market_ticker) market_ticker, game_id, target_team, market_title
FROM winners WHERE {PLAYED} ORDER BY market_ticker, game_id""",
        TICKERS,
    ),
    "build_tables_failed": query(
        f"""SELECT t.game_id,
    if(f.game_id IS NULL, 'no markets found', 'no winner market') AS reason,
    coalesce(f.event_ticker, array_to_string(t.list, ', ')) AS tried
FROM tries t LEFT JOIN found f USING (game_id)
WHERE t.{PLAYED} AND t.game_id NOT IN (SELECT game_id FROM winners)""",
        TICKERS,
    ),
    "build_tables_increment": query(INGESTED_PRICES, TICKERS, SECONDS),
    "build_tables_increment_games": query(f"FROM games WHERE {PLAYED}"),
    "build_tables_increment_plays": query("FROM plays WHERE timestamp_utc IS NOT NULL"),
    "build_tables_increment_teams": query(
        f"""SELECT code AS team_abbr,
    if(code < 'T20', 'Team ' || code[2:]::INTEGER, code) AS team_name
FROM (SELECT home_team AS code FROM games WHERE {PLAYED}
      UNION SELECT away_team FROM games WHERE {PLAYED})"""
    ),
    "build_tables_increment_markets": query(
        f"SELECT DISTINCT market_ticker, target_team FROM winners WHERE {PLAYED}", TICKERS
    ),
    "landed_candles": query(
        """SELECT 'MK-' || u AS market_ticker, s - INTERVAL 5 HOUR AS datetime_utc, o AS kalshi_open,
    greatest(o, c) AS kalshi_high, least(o, c) AS kalshi_low, c AS kalshi_close,
    v AS kalshi_volume, epoch_us(s) // 1000000 AS end_period_ts
FROM seconds""",
        SECONDS,
    ),
    "rejected_payloads": query(
        """SELECT DISTINCT 'candles' AS kind, 'MK-' || u AS ticker,
    '{"candlesticks":[{"e' AS payload
FROM raw_candles WHERE u % 7 = 0"""
    ),
    "play_by_play_files": query("FROM plays WHERE timestamp_utc IS NOT NULL"),
    "load_tables": query(
        """SELECT
    (SELECT count(team_name) FROM teams) AS teams,
    (SELECT count(away_team) FROM games) AS games,
    (SELECT max(game_date) FROM games) AS last_game_date,
    (SELECT count(description) FROM plays) AS plays,
    (SELECT count(down) FROM plays) AS plays_with_down,
    (SELECT sum(play_id)::BIGINT FROM plays) AS play_id_sum,
    (SELECT max(timestamp_utc) FROM plays) AS last_play_at,
    (SELECT sum(length(description))::BIGINT FROM plays) AS description_chars,
    (SELECT count(market_title) FROM markets) AS markets,
    (SELECT count(*) FROM prices) AS candles,
    (SELECT sum(round(kalshi_close * 100)::BIGINT)::BIGINT FROM prices) AS cents,
    (SELECT min(datetime_utc) FROM prices) AS first_candle_at"""
    ),
    "load_tables_teams": query("FROM teams"),
    "load_tables_games": query("FROM games"),
    "load_tables_plays": query(
        """SELECT * REPLACE ('said "go, ' || description || '"' || chr(10) || play_type AS description)
FROM plays"""
    ),
    "load_tables_markets": query("FROM markets"),
    "load_tables_prices": query("FROM prices"),
    "rejected_csv_rows": query(
        """SELECT 'games' AS table_name,
    concat_ws(',', game_id, season, 'third', home_team, away_team, game_date) AS bad_row
FROM games WHERE week = 3"""
    ),
    "stored_plays": query("FROM plays"),
    "stored_prices": query("FROM prices"),
    "stored_twice_plays": query("FROM plays"),
    "stored_twice_prices": query("FROM prices"),
    "csv_only_if_absent": query("FROM teams"),
    "check_keys": query(
        """SELECT 'teams' AS table_name, 'team_abbr' AS columns, 'primary key' AS rule,
       count(*) - count(DISTINCT team_abbr) AS violations FROM teams
UNION ALL SELECT 'teams', 'team_name', 'not null', count(*) - count(team_name) FROM teams
UNION ALL SELECT 'games', 'game_id', 'primary key', count(*) - count(DISTINCT game_id) FROM games
UNION ALL SELECT 'plays', 'game_id, play_id', 'primary key',
       count(*) - count(DISTINCT (game_id, play_id)) FROM plays
UNION ALL SELECT 'kalshi_markets', 'market_ticker', 'primary key',
       count(*) - count(DISTINCT market_ticker) FROM markets
UNION ALL SELECT 'kalshi_prices', 'market_ticker, datetime_utc', 'primary key',
       count(*) - count(DISTINCT (market_ticker, datetime_utc)) FROM prices"""
    ),
    "check_keys_damaged": query(
        "\nUNION ALL ".join(
            [
                bad_keys("teams", "team_abbr"),
                "SELECT 'teams', 'team_name', 'not null', count(*) FROM bad_teams WHERE team_name IS NULL",
                bad_keys("games", "game_id"),
                bad_keys("plays", "game_id", "play_id"),
                bad_keys("kalshi_markets", "market_ticker"),
                bad_keys("kalshi_prices", "market_ticker", "datetime_utc"),
            ]
        ),
        DAMAGE,
    ),
    "check_references_damaged": query(orphans("bad_"), DAMAGE),
    "key_violations": query(
        """SELECT game_id, down, count(*) AS occurrences FROM plays GROUP BY game_id, down
HAVING count(*) > 1 OR game_id IS NULL OR down IS NULL"""
    ),
    "check_references": query(orphans("")),
    "orphans": query(
        """SELECT game_id AS orphan_key, count(*) AS occurrences FROM plays
WHERE game_id NOT IN (SELECT game_id FROM markets) GROUP BY game_id"""
    ),
}

# What two landings leave is what one ingest of both gives.
ORACLES |= {
    f"taken_in_{name}": ORACLES[f"build_tables_increment{suffix}"]
    for name, suffix in (("prices", ""), ("games", "_games"), ("plays", "_plays"))
}
