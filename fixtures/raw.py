"""Raw ingest shapes built from the test tables.

Fixed rules, by u = user_id:

* u % 10 = 9: no market list was landed; u % 20 = 6: an empty one;
  u % 20 = 4: one without a winner market; else a spread market, then the winner.
* The event is listed under the candidate ticker number u % 4 of its game
  (0 own codes, 1 own codes a day later, 2 market codes, 3 market codes a day later);
  game G7 is listed under an override ticker.
* Candles arrive in pages of 500 event ids, so that no page grows with the data.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from fixtures import relations as rel
from fourthtick.plans import ingest
from fourthtick.sources import storage

CODES = {"T03": "X03", "T11": "X11"}
OVERRIDES = {"G7": "EV-SPECIAL"}
TEAM_NAMES = {f"T{n:02d}": f"Team {n}" for n in range(20)}
PREFIX = "GAME-"

FLOATS = set(ingest.COUNTERS)


def play_by_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {**rel.GAME, **rel.PLAY}
    columns |= {name: f"cast({rel.PLAY[name]} as double)" for name in FLOATS}
    columns["game_date"] = f"cast({rel.GAME['game_date']} as string)"
    columns["desc"] = columns.pop("description")
    clock = columns.pop("timestamp_utc")
    columns["time_of_day"] = f"concat(translate(cast({clock} as string), ' ', 'T'), 'Z')"
    return rel.pick(rel.play_events(spark, sf_dir), columns)


def _market_code(code: str) -> str:
    return f"CASE {code} WHEN 'T03' THEN 'X03' WHEN 'T11' THEN 'X11' ELSE {code} END"


def _event_ticker() -> str:
    home, away = rel.GAME["home_team"], rel.GAME["away_team"]
    own, market = f"concat({away}, {home})", f"concat({_market_code(away)}, {_market_code(home)})"
    day = f"date_add({rel.GAME['game_date']}, cast(user_id % 2 as int))"
    return (
        "if(user_id = 7, 'EV-SPECIAL',"
        f" concat('{PREFIX}', upper(date_format({day}, 'yyMMMdd')), if(user_id % 4 < 2, {own}, {market})))"
    )


# Ticker of the winner market of a user's game, as the landed lists name it.
WINNER_TICKER = f"concat({_event_ticker()}, '-', {_market_code(rel.MARKET['target_team'])})"

CLOSE_TIME = "concat('2024-01-', 10 + user_id % 10, 'T06:00:00Z')"


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market lists landed as JSON files, one line per event."""
    named = rel.users(spark, sf_dir).filter(rel.HAS_MARKET).selectExpr(
        "user_id",
        f"{_event_ticker()} AS event_ticker",
        f"{WINNER_TICKER} AS winner",
        f"{rel.GAME['home_team']} AS home",
        f"{CLOSE_TIME} AS close_time",
    )

    def market(ticker: str, title: str) -> str:
        return f"named_struct('ticker', {ticker}, 'title', {title}, 'close_time', close_time)"

    spread = market("concat(event_ticker, '-S')", "concat(home, ' WIN spread')")
    winner = market("winner", "concat(home, ' Win')")
    listing = (
        f"CASE user_id % 20 WHEN 6 THEN slice(array({spread}), 1, 0) WHEN 4 THEN array({spread})"
        f" ELSE array({spread}, {winner}) END"
    )
    lines = named.selectExpr(
        "event_ticker", f"to_json(named_struct('markets', {listing})) AS payload"
    )
    folder = f"{storage.shared_folder(spark)}/markets-{uuid.uuid4().hex}"
    lines.write.json(folder)
    return storage.read_landed_markets(spark, folder)


def candles(
    spark: SparkSession, sf_dir: str, ticker: str = rel.MARKET["market_ticker"]
) -> DataFrame:
    """Landed candle lists, pages of each market's candles."""
    prices = ", ".join(
        f"'{name}', cast(nullif({rel.PRICE[f'kalshi_{name}']}, 0D) as string)"
        for name in ("open", "high", "low", "close")
    )
    seconds = (
        "unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"
    )
    candle = (
        f"named_struct('end_period_ts', {seconds}, 'price', named_struct({prices}),"
        " 'volume', concat(event_id % 50, '.00'))"
    )
    return (
        rel.candle_events(spark, sf_dir)
        .selectExpr(
            f"{ticker} AS market_ticker",
            "event_id div 500 AS page",
            f"{candle} AS candle",
        )
        .groupBy("market_ticker", "page")
        .agg({"candle": "collect_list"})
        .selectExpr(
            "market_ticker",
            "to_json(named_struct('candlesticks', `collect_list(candle)`)) AS payload",
        )
    )


def candle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candle lists as files: every market's page 0 twice, and a broken response of some markets."""
    pages = candles(spark, sf_dir)
    broken = pages.filter("cast(substr(market_ticker, 4) as int) % 7 = 0").selectExpr(
        "market_ticker", "substr(payload, 1, 20) AS payload"
    )
    folder = f"{storage.shared_folder(spark)}/candles-{uuid.uuid4().hex}"
    pages.write.json(folder)
    pages.unionByName(broken.distinct()).write.mode("append").json(folder)
    return storage.read_landed_candles(spark, folder)


def play_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play files of which some hold floats and some integers."""
    rows = play_by_play(spark, sf_dir)
    folder = f"{storage.shared_folder(spark)}/plays-{uuid.uuid4().hex}"
    rows.filter("play_id % 2 = 0").write.parquet(folder)
    whole = {name: rows[name].cast("long") for name in FLOATS}
    rows.filter("play_id % 2 = 1").withColumns(whole).write.mode("append").parquet(folder)
    return storage.read_play_by_play(spark, folder)


def closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing time of each market of the relations."""
    return (
        rel.users(spark, sf_dir)
        .filter(rel.HAS_MARKET)
        .selectExpr(f"{rel.MARKET['market_ticker']} AS market_ticker", f"{CLOSE_TIME} AS close_time")
    )
