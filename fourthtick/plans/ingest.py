"""From landed files to the five tables, as set operations over all games at once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from fourthtick import schemas
from fourthtick.functions.text import replace_codes
from fourthtick.functions.times import EASTERN, from_epoch_seconds, utc_to_wall
from fourthtick.sources.storage import stage
from fourthtick.tables import Tables

# Names of the teams by their code.
TEAM_NAMES = {
    "ARI": "Arizona Cardinals",
    "ATL": "Atlanta Falcons",
    "BAL": "Baltimore Ravens",
    "BUF": "Buffalo Bills",
    "CAR": "Carolina Panthers",
    "CHI": "Chicago Bears",
    "CIN": "Cincinnati Bengals",
    "CLE": "Cleveland Browns",
    "DAL": "Dallas Cowboys",
    "DEN": "Denver Broncos",
    "DET": "Detroit Lions",
    "GB": "Green Bay Packers",
    "HOU": "Houston Texans",
    "IND": "Indianapolis Colts",
    "JAX": "Jacksonville Jaguars",
    "KC": "Kansas City Chiefs",
    "LA": "Los Angeles Rams",
    "LAC": "Los Angeles Chargers",
    "LV": "Las Vegas Raiders",
    "MIA": "Miami Dolphins",
    "MIN": "Minnesota Vikings",
    "NE": "New England Patriots",
    "NO": "New Orleans Saints",
    "NYG": "New York Giants",
    "NYJ": "New York Jets",
    "PHI": "Philadelphia Eagles",
    "PIT": "Pittsburgh Steelers",
    "SEA": "Seattle Seahawks",
    "SF": "San Francisco 49ers",
    "TB": "Tampa Bay Buccaneers",
    "TEN": "Tennessee Titans",
    "WAS": "Washington Commanders",
}

# Team codes that the market spells differently.
MARKET_CODES = {"JAX": "JAC"}

# Prefix of a game's event ticker, and the games whose event has
# a ticker of another form.
EVENT_PREFIX = "KXNFLGAME-"
TICKER_OVERRIDES = {"2025_22_SEA_NE": "KXSB-26", "2025_21_NE_DEN": "KXNFLAFCCHAMP-25"}

# A market's candles are kept for this long before it closes.
CANDLE_SPAN = timedelta(seconds=14400)

# Columns that may arrive as floats and are integers in the table.
COUNTERS = [
    f.name
    for f in schemas.PLAYS.fields
    if f.dataType == IntegerType() and f.name in schemas.RAW_PLAY_BY_PLAY.fieldNames()
]

_BAD = "_bad_payload"


def _parsed(schema: StructType) -> Column:
    """A landed payload; what is not JSON of this shape as a whole is kept as ``_BAD``."""
    checked = StructType([*schema.fields, StructField(_BAD, StringType())])
    return F.from_json("payload", checked, {"columnNameOfCorruptRecord": _BAD})


def _unreadable(schema: StructType) -> Column:
    parsed = _parsed(schema)
    return parsed.isNull() | parsed[_BAD].isNotNull()


def readable(landed: DataFrame, schema: StructType) -> DataFrame:
    return landed.filter(~_unreadable(schema))


def rejected_payloads(landed_markets: DataFrame, landed_candles: DataFrame) -> DataFrame:
    """Landed responses that cannot be read and are left out of the tables: kind, ticker, payload."""
    return (
        landed_markets.filter(_unreadable(schemas.MARKETS_PAYLOAD))
        .select(F.lit("markets").alias("kind"), F.col("event_ticker").alias("ticker"), "payload")
        .unionByName(
            landed_candles.filter(_unreadable(schemas.CANDLES_PAYLOAD)).select(
                F.lit("candles").alias("kind"), F.col("market_ticker").alias("ticker"), "payload"
            )
        )
    )


def build_games(raw: DataFrame) -> DataFrame:
    """One row per game of the play-by-play.

    All plays of a game repeat the same columns; ``distinct`` removes them by
    hashing before anything is sorted or moved. Should a game differ in some
    play, one of its rows is kept.
    """
    per_play = raw.select(
        "game_id",
        "season",
        "week",
        F.col("game_date").cast("date").alias("game_date"),
        "home_team",
        "away_team",
    )
    return per_play.distinct().dropDuplicates(["game_id"])


def build_plays(raw: DataFrame) -> DataFrame:
    """Plays with a time of day; counters as integers, time as a zone-less UTC timestamp."""
    clock = F.regexp_replace("time_of_day", "Z$", "").cast("timestamp_ntz")
    return (
        raw.filter(F.col("time_of_day").isNotNull())
        .withColumns({c: F.col(c).cast("int") for c in COUNTERS})
        .withColumns({"description": F.col("desc"), "timestamp_utc": clock})
        .select(*schemas.PLAYS.fieldNames())
    )


def build_teams(games: DataFrame, names: Mapping[str, str] = TEAM_NAMES) -> DataFrame:
    """Every team that occurs in a game; a code without a name stands for itself."""
    codes = (
        games.select(F.col("home_team").alias("team_abbr"))
        .union(games.select(F.col("away_team").alias("team_abbr")))
        .distinct()
    )
    return codes.withColumn("team_name", replace_codes(F.col("team_abbr"), names))


def _candidates(
    overrides: Mapping[str, str], market_codes: Mapping[str, str], prefix: str
) -> Column:
    home, away = F.col("home_team"), F.col("away_team")
    own = F.concat(away, home)
    market = F.concat(replace_codes(away, market_codes), replace_codes(home, market_codes))

    def ticker(days: int, teams: Column) -> Column:
        day = F.upper(F.date_format(F.date_add("game_date", days), "yyMMMdd"))
        return F.concat(F.lit(prefix), day, teams)

    # The market dates games in UTC, so evening games fall on the next day.
    guesses = F.array_distinct(
        F.array(ticker(0, own), ticker(0, market), ticker(1, own), ticker(1, market))
    )
    if not overrides:
        return guesses
    known = F.create_map(*[F.lit(x) for pair in sorted(overrides.items()) for x in pair])
    fixed = F.try_element_at(known, F.col("game_id"))
    return F.when(fixed.isNotNull(), F.array(fixed)).otherwise(guesses)


def event_ticker_candidates(
    games: DataFrame,
    overrides: Mapping[str, str] = TICKER_OVERRIDES,
    market_codes: Mapping[str, str] = MARKET_CODES,
    prefix: str = EVENT_PREFIX,
) -> DataFrame:
    """Event tickers a game may have, in the order to try them. An override stands alone."""
    tickers = _candidates(overrides, market_codes, prefix)
    return games.select("game_id", F.posexplode(tickers).alias("pos", "ticker"))


def resolve_event_ticker(candidates: DataFrame, landed: DataFrame) -> DataFrame:
    """First candidate of each game for which markets exist."""
    listed = F.size(_parsed(schemas.MARKETS_PAYLOAD)["markets"]) > 0
    existing = readable(landed, schemas.MARKETS_PAYLOAD).filter(listed).select(F.col("event_ticker").alias("ticker")).distinct()
    return (
        candidates.join(existing, "ticker")
        .groupBy("game_id")
        .agg(F.min_by("ticker", "pos").alias("event_ticker"))
    )


def _first_winner_market(
    landed: DataFrame, resolved: DataFrame, games: DataFrame, market_codes: Mapping[str, str]
) -> DataFrame:
    """Each resolved game with its winner market ``m``, NULL where its event has none.

    Each list is cut down to its winner markets where it is read, so that is all
    that travels; the game's team codes then pick from it. An event that was
    landed several times counts once per distinct list, and any of its lists may
    hold the market: with a column ``landed_at`` the first that does, else the
    smallest ticker. Unreadable lists are left out (see ``rejected_payloads``).
    """

    def about_winner(market: Column) -> Column:
        title = F.lower(market["title"])
        return title.contains("win") & ~title.contains("spread")

    def names_a_team(market: Column) -> Column:
        return F.exists("codes", lambda code: market["ticker"].contains(code))

    markets = _parsed(schemas.MARKETS_PAYLOAD)["markets"]
    landed_at = F.col("landed_at") if "landed_at" in landed.columns else F.lit(None).cast("long")
    winner_lists = (
        readable(landed, schemas.MARKETS_PAYLOAD)
        .select(
            "event_ticker",
            F.filter(markets, about_winner).alias("markets"),
            landed_at.alias("landed_at"),
        )
        .groupBy("event_ticker", "markets")
        .agg(F.min("landed_at").alias("landed_at"))
    )

    teams = F.array("home_team", "away_team")
    codes = F.concat(teams, F.transform(teams, lambda c: replace_codes(c, market_codes)))
    first = F.get(F.filter("markets", names_a_team), F.lit(0))
    return (
        resolved.join(games.select("game_id", codes.alias("codes")), "game_id")
        .join(winner_lists, "event_ticker")
        .select("game_id", "event_ticker", "landed_at", first.alias("m"))
        .groupBy("game_id", "event_ticker")
        .agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.struct("landed_at", "m"))).alias("m"))
    )


def select_winner_market(
    landed: DataFrame,
    resolved: DataFrame,
    games: DataFrame,
    market_codes: Mapping[str, str] = MARKET_CODES,
) -> DataFrame:
    """First market of each game's event that asks who wins and names a team of the game."""
    return _winners(_first_winner_market(landed, resolved, games, market_codes))


def _winners(found: DataFrame) -> DataFrame:
    return found.filter(F.col("m").isNotNull()).select(
        "game_id",
        "event_ticker",
        F.col("m.ticker").alias("market_ticker"),
        F.col("m.title").alias("market_title"),
        F.col("m.close_time").alias("close_time"),
    )


def market_target_team(
    winners: DataFrame, market_codes: Mapping[str, str] = MARKET_CODES
) -> DataFrame:
    """Market rows: the last part of a ticker names the team, in the market's spelling."""
    own_codes = {market: own for own, market in market_codes.items()}
    code = F.element_at(F.split("market_ticker", "-"), -1)
    return winners.select(
        "market_ticker",
        "game_id",
        replace_codes(code, own_codes).alias("target_team"),
        "market_title",
    )


def _candle_rows(pages: DataFrame, candles: Column, zone: str) -> DataFrame:
    """One row per candle of an array, with its epoch second."""

    def price(name: str) -> Column:
        text = F.nullif(F.col(f"price.{name}"), F.lit(""))
        return F.coalesce(text.cast("double"), F.lit(0.0)).alias(f"kalshi_{name}")

    return pages.select("market_ticker", F.inline(candles)).select(
        "market_ticker",
        utc_to_wall(from_epoch_seconds(F.col("end_period_ts")), zone).alias("datetime_utc"),
        price("open"),
        price("high"),
        price("low"),
        price("close"),
        F.coalesce(F.col("volume").cast("double").cast("int"), F.lit(0)).alias("kalshi_volume"),
        "end_period_ts",
    )


def flatten_candles(landed: DataFrame, zone: str = EASTERN) -> DataFrame:
    """One row per candle of every readable page, with its epoch second.

    A missing price is 0, a missing volume is 0, and ``datetime_utc`` holds the
    wall clock of ``zone``. A page that was landed twice gives its candles twice;
    ``unique_candles`` keeps one of them.
    """
    candles = _parsed(schemas.CANDLES_PAYLOAD)["candlesticks"]
    return _candle_rows(readable(landed, schemas.CANDLES_PAYLOAD), candles, zone)


def unique_candles(candles: DataFrame) -> DataFrame:
    """One candle per market and second: the one with the largest volume, then close.

    Equal pages collapse in the map-side aggregate, and the key spreads a hot market.
    """
    ranked = ["kalshi_volume", "kalshi_close", "kalshi_high", "kalshi_low", "kalshi_open"]
    best = candles.groupBy("market_ticker", "end_period_ts").agg(
        F.max(F.struct(*ranked, "datetime_utc")).alias("best")
    )
    return best.select(
        "market_ticker", *[F.col(f"best.{c}").alias(c) for c in candles.columns[1:-1]], "end_period_ts"
    )


def _closings(winners: DataFrame) -> DataFrame:
    closing = F.unix_timestamp(F.col("close_time").cast("timestamp"))
    return winners.select("market_ticker", closing.alias("closed_at")).distinct()


def candle_window(
    candles: DataFrame, winners: DataFrame, span: timedelta = CANDLE_SPAN
) -> DataFrame:
    """Candles in the last ``span`` before their market closed, as price rows."""
    seconds = int(span.total_seconds())
    return (
        candles.join(_closings(winners), "market_ticker")
        .filter(F.col("end_period_ts").between(F.col("closed_at") - seconds, F.col("closed_at")))
        .select(*schemas.PRICES.fieldNames())
    )


def landed_window(
    landed: DataFrame, winners: DataFrame, span: timedelta = CANDLE_SPAN, zone: str = EASTERN
) -> DataFrame:
    """``candle_window`` of landed pages, one row per market and candle.

    Pages meet their market's closing time as they are, and their candles are cut to
    the window inside the array: candles outside it are never rows of their own.
    """
    seconds = int(span.total_seconds())
    candles = F.filter(
        _parsed(schemas.CANDLES_PAYLOAD)["candlesticks"],
        lambda c: c["end_period_ts"].between(F.col("closed_at") - seconds, F.col("closed_at")),
    )
    pages = readable(landed, schemas.CANDLES_PAYLOAD).join(_closings(winners), "market_ticker")
    return unique_candles(_candle_rows(pages, candles, zone)).select(*schemas.PRICES.fieldNames())


def incremental_new_games(
    games: DataFrame, markets: DataFrame, force: Iterable[str] = ()
) -> DataFrame:
    """Games that have no market yet, and those to be fetched again by force."""
    done = markets.select("game_id").filter(~F.col("game_id").isin(list(force))).distinct()
    return games.join(done, "game_id", "left_anti")


def append_markets(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing markets and the new ones whose ticker is not known yet.

    Where several games claim one new ticker, the first game keeps it.
    """
    return existing.unionByName(unknown_markets(existing, new))


def unknown_markets(existing: DataFrame, new: DataFrame) -> DataFrame:
    columns = schemas.MARKETS.fieldNames()
    first = new.groupBy("market_ticker").agg(
        F.min_by(F.struct(*columns), "game_id").alias("market")
    )
    return first.join(existing.select("market_ticker"), "market_ticker", "left_anti").select(
        "market.*"
    )


def append_prices(existing_prices: DataFrame, added: DataFrame, new_prices: DataFrame) -> DataFrame:
    """Existing candles and those of the markets that were added."""
    fresh = new_prices.join(added.select("market_ticker"), "market_ticker", "left_semi")
    return existing_prices.unionByName(fresh.select(*existing_prices.columns))


def failed_games_report(
    games: DataFrame,
    landed: DataFrame,
    overrides: Mapping[str, str] = TICKER_OVERRIDES,
    market_codes: Mapping[str, str] = MARKET_CODES,
    prefix: str = EVENT_PREFIX,
) -> DataFrame:
    """Games without a usable market: the reason, and the tickers that were tried."""
    candidates = event_ticker_candidates(games, overrides, market_codes, prefix)
    resolved = resolve_event_ticker(candidates, landed)
    found = _first_winner_market(landed, resolved, games, market_codes)
    return _failures(games, found, _candidates(overrides, market_codes, prefix), landed)


def _failures(
    games: DataFrame, found: DataFrame, candidates: Column, landed: DataFrame
) -> DataFrame:
    all_tickers = F.array_join("tickers", ", ")
    failed = (
        games.select("game_id", candidates.alias("tickers"))
        .join(found, "game_id", "left")
        .filter(F.col("m").isNull())
    )
    broken = landed.filter(_unreadable(schemas.MARKETS_PAYLOAD))
    tried = failed.select("game_id", F.explode("tickers").alias("event_ticker"))
    unread = (
        tried.join(broken.select("event_ticker").distinct(), "event_ticker", "left_semi")
        .select("game_id", F.lit(True).alias("unread"))
        .distinct()
    )
    return failed.join(unread, "game_id", "left").select(
        "game_id",
        F.when(F.col("event_ticker").isNotNull(), "no winner market")
        .when(F.col("unread"), "unreadable response")
        .otherwise("no markets found")
        .alias("reason"),
        F.coalesce("event_ticker", all_tickers).alias("tried"),
    )


def build_increment(
    play_by_play: DataFrame,
    landed_markets: DataFrame,
    landed_candles: DataFrame,
    existing: Tables | None = None,
    force: Iterable[str] = (),
    team_names: Mapping[str, str] = TEAM_NAMES,
    overrides: Mapping[str, str] = TICKER_OVERRIDES,
    market_codes: Mapping[str, str] = MARKET_CODES,
    prefix: str = EVENT_PREFIX,
    zone: str = EASTERN,
) -> tuple[Tables, DataFrame]:
    """What landed data add to ``existing`` tables, and the report of failed games.

    The first frame set holds new rows only: teams and games not known yet, the plays
    of those games, and for every game without a market (and those in ``force``) its
    market and candles. ``storage.save_tables(..., mode="append")`` stores it next to
    what is there. The winner markets are staged while the plan is built.
    """
    spark = play_by_play.sparkSession
    known = existing or Tables(
        *[spark.createDataFrame([], schema) for schema in schemas.TABLES.values()]
    )
    games = build_games(play_by_play)
    new_games = games.join(known.games.select("game_id"), "game_id", "left_anti")
    plays = build_plays(play_by_play).join(
        known.games.select("game_id"), "game_id", "left_anti"
    )
    teams = build_teams(games, team_names).join(
        known.teams.select("team_abbr"), "team_abbr", "left_anti"
    )

    every_game = known.games.unionByName(new_games)
    open_games = incremental_new_games(every_game, known.markets, force)
    candidates = event_ticker_candidates(open_games, overrides, market_codes, prefix)
    resolved = resolve_event_ticker(candidates, landed_markets)
    # Markets, candles and the report of failures all start from this result.
    found = stage(
        _first_winner_market(landed_markets, resolved, open_games, market_codes), "winner_markets"
    )
    winners = _winners(found)
    added = unknown_markets(known.markets, market_target_team(winners, market_codes))
    # Small sides first: only closing times of added markets meet the pages.
    closing = winners.join(added.select("market_ticker"), "market_ticker", "left_semi")
    delta = Tables(
        teams=teams,
        games=new_games,
        plays=plays.select(*schemas.PLAYS.fieldNames()),
        markets=added,
        prices=landed_window(landed_candles, closing, zone=zone),
    )
    tried = _candidates(overrides, market_codes, prefix)
    return delta, _failures(open_games, found, tried, landed_markets)


def build_tables(
    play_by_play: DataFrame,
    landed_markets: DataFrame,
    landed_candles: DataFrame,
    existing: Tables | None = None,
    force: Iterable[str] = (),
    **settings,
) -> tuple[Tables, DataFrame]:
    """The whole ingest: landed data to the five tables, and the report of failed games.

    With ``existing`` tables the result holds their rows and those ``build_increment``
    adds; to store an increment, append that instead.
    """
    delta, failed = build_increment(
        play_by_play, landed_markets, landed_candles, existing, force, **settings
    )
    if existing is None:
        return delta, failed
    parts = zip(existing.named().values(), delta.named().values(), strict=True)
    return Tables(*[old.unionByName(new.select(*old.columns)) for old, new in parts]), failed
