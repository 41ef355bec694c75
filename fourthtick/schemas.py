"""Explicit schemas: stored tables, landed CSV files, landed JSON payloads.

Table and column names are fixed values of the data model.
"""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_S, _I, _D = StringType(), IntegerType(), DoubleType()


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


TEAMS = _schema(team_abbr=_S, team_name=_S)

GAMES = _schema(
    game_id=_S, season=_I, week=_I, game_date=DateType(), home_team=_S, away_team=_S
)

PLAYS = _schema(
    game_id=_S,
    play_id=_I,
    qtr=_I,
    quarter_seconds_remaining=_D,
    down=_I,
    ydstogo=_I,
    play_type=_S,
    description=_S,
    total_home_score=_I,
    total_away_score=_I,
    wp=_D,
    vegas_wp=_D,
    interception=_I,
    fumble=_I,
    touchdown=_I,
    timestamp_utc=TimestampNTZType(),
)

MARKETS = _schema(market_ticker=_S, game_id=_S, target_team=_S, market_title=_S)

PRICES = _schema(
    market_ticker=_S,
    datetime_utc=TimestampNTZType(),
    kalshi_open=_D,
    kalshi_high=_D,
    kalshi_low=_D,
    kalshi_close=_D,
    kalshi_volume=_I,
)

TABLES = {
    "teams": TEAMS,
    "games": GAMES,
    "plays": PLAYS,
    "kalshi_markets": MARKETS,
    "kalshi_prices": PRICES,
}

KEYS = {
    "teams": ["team_abbr"],
    "games": ["game_id"],
    "plays": ["game_id", "play_id"],
    "kalshi_markets": ["market_ticker"],
    "kalshi_prices": ["market_ticker", "datetime_utc"],
}

REQUIRED = {"teams": ["team_name"]}

# (child table, child column, parent table, parent column)
REFERENCES = [
    ("games", "home_team", "teams", "team_abbr"),
    ("games", "away_team", "teams", "team_abbr"),
    ("plays", "game_id", "games", "game_id"),
    ("kalshi_markets", "game_id", "games", "game_id"),
    ("kalshi_markets", "target_team", "teams", "team_abbr"),
    ("kalshi_prices", "market_ticker", "kalshi_markets", "market_ticker"),
]

# Column order inside the landed CSV files. Only games differs in order (the
# date comes last) and only plays differs in a name (desc).
CSV_ORDER = {name: schema.fieldNames() for name, schema in TABLES.items()}
CSV_ORDER["games"] = ["game_id", "season", "week", "home_team", "away_team", "game_date"]
CSV_RENAMED = {"plays": {"description": "desc"}}


def csv_schema(table: str) -> StructType:
    """Schema of a table's CSV file, in file order and with file column names."""
    renamed = CSV_RENAMED.get(table, {})
    return StructType(
        [
            StructField(renamed.get(name, name), TABLES[table][name].dataType)
            for name in CSV_ORDER[table]
        ]
    )


# Raw play-by-play columns; the counters may arrive as floats.
RAW_PLAY_BY_PLAY = _schema(
    game_id=_S,
    season=_I,
    week=_I,
    home_team=_S,
    away_team=_S,
    game_date=_S,
    play_id=_D,
    qtr=_D,
    quarter_seconds_remaining=_D,
    down=_D,
    ydstogo=_D,
    play_type=_S,
    desc=_S,
    total_home_score=_D,
    total_away_score=_D,
    wp=_D,
    vegas_wp=_D,
    interception=_D,
    fumble=_D,
    touchdown=_D,
    time_of_day=_S,
)

# One landed line per request: what was asked for, and the response body.
LANDED_MARKETS = _schema(event_ticker=_S, payload=_S)
LANDED_CANDLES = _schema(market_ticker=_S, payload=_S)

MARKETS_PAYLOAD = _schema(markets=ArrayType(_schema(ticker=_S, title=_S, close_time=_S)))

CANDLES_PAYLOAD = _schema(
    candlesticks=ArrayType(
        _schema(
            end_period_ts=LongType(),
            price=_schema(open=_S, high=_S, low=_S, close=_S),
            volume=_S,
        )
    )
)
