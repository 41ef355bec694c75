"""Test tables -> the five relations. The mapping is specified in FIXTURES.md."""

from pyspark.sql import DataFrame, SparkSession

from fourthtick import Tables, schemas

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"

HAS_MARKET = "user_id % 10 <> 9"
HOME = "user_id % 25"
AWAY = "(user_id % 25 + 1 + user_id div 25 % 24) % 25"


def code(number: str) -> str:
    return f"concat('T', lpad(cast({number} as string), 2, '0'))"


# Columns of a game, as expressions over user_id.
GAME = {
    "game_id": "concat('G', user_id)",
    "season": "2024",
    "week": "cast(1 + user_id % 20 as int)",
    "game_date": "date_add(DATE'2024-01-01', cast(user_id % 10 as int))",
    "home_team": code(HOME),
    "away_team": code(AWAY),
}

MARKET = {
    "market_ticker": "concat('MK-', user_id)",
    "game_id": GAME["game_id"],
    "target_team": f"if(user_id % 3 = 0, {code(AWAY)}, {code(HOME)})",
    "market_title": f"concat({code(HOME)}, ' win')",
}

OPEN = "if(event_id % 23 = 0, 0D, (1 + (53 * event_id + 7 * user_id) % 99) / 100)"
CLOSE = "if(event_id % 23 = 0, 0D, (1 + (37 * event_id + 11 * user_id) % 99) / 100)"

PRICE = {
    "market_ticker": MARKET["market_ticker"],
    "datetime_utc": "ts - INTERVAL '5' HOUR",
    "kalshi_open": OPEN,
    "kalshi_high": f"greatest({OPEN}, {CLOSE})",
    "kalshi_low": f"least({OPEN}, {CLOSE})",
    "kalshi_close": CLOSE,
    "kalshi_volume": "cast(event_id % 50 as int)",
}

HOME_SCORE = "cast(3 * ((7 * event_id) % 11) as int)"
AWAY_SCORE = "cast(3 * ((5 * event_id + user_id) % 11) as int)"
WP = f"({HOME_SCORE} - {AWAY_SCORE} + 40) / 80D"

PLAY = {
    "game_id": GAME["game_id"],
    "play_id": "cast(event_id as int)",
    "qtr": "cast(1 + (day(ts) - 1) div 7 as int)",
    "quarter_seconds_remaining": "cast(900 - (31 * event_id) % 900 as double)",
    "down": "if(event_id % 19 = 0, NULL, cast(1 + event_id % 4 as int))",
    "ydstogo": "cast(1 + event_id % 10 as int)",
    "play_type": "event_type",
    "description": "props",
    "total_home_score": HOME_SCORE,
    "total_away_score": AWAY_SCORE,
    "wp": WP,
    "vegas_wp": f"if(event_id % 17 = 0, NULL, {WP})",
    "interception": "cast(event_id % 29 = 0 as int)",
    "fumble": "cast(event_id % 31 = 0 as int)",
    "touchdown": "cast(event_id % 37 = 0 as int)",
    "timestamp_utc": "if(event_id % 13 = 0, NULL, ts)",
}


def pick(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*[f"{value} AS {name}" for name, value in expressions.items()])


def read(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", EVENTS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id").distinct()


def candle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(
        f"event_type IN ('view', 'click', 'purchase') AND {HAS_MARKET}"
    )


def play_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type IN ('signup', 'error') AND user_id % 14 <> 13")


def relations(spark: SparkSession, sf_dir: str) -> Tables:
    nations = read(spark, sf_dir, "nation", "n_nationkey int, n_name string")
    games = users(spark, sf_dir)
    return Tables(
        teams=nations.selectExpr(f"{code('n_nationkey')} AS team_abbr", "n_name AS team_name"),
        games=pick(games, GAME),
        plays=pick(play_events(spark, sf_dir), PLAY).select(*schemas.PLAYS.fieldNames()),
        markets=pick(games.filter(HAS_MARKET), MARKET),
        prices=pick(candle_events(spark, sf_dir), PRICE),
    )
