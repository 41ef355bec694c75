import json
from datetime import date, datetime

from build import frame, game, market, rows
from fourthtick import schemas
from fourthtick.plans import ingest
from pyspark.sql import functions as F


def landed_markets(spark, lists):
    lines = [(event, json.dumps({"markets": m, "cursor": ""})) for event, m in lists]
    return spark.createDataFrame(lines, schemas.LANDED_MARKETS)


def listed(ticker, title, close="2025-09-08T00:30:00Z"):
    return {"ticker": ticker, "title": title, "close_time": close, "status": "finalized"}


def dated(game_id, away, home, day):
    return game(game_id, home, away, game_date=day)


def test_tickers_of_an_ordinary_game(spark):
    games = frame(spark, "games", [dated("G", "DAL", "PHI", date(2025, 9, 30))])
    found = rows(ingest.event_ticker_candidates(games))
    assert found == [
        ("G", 0, "KXNFLGAME-25SEP30DALPHI"),
        ("G", 1, "KXNFLGAME-25OCT01DALPHI"),
    ]


def test_tickers_of_a_team_the_market_spells_differently(spark):
    games = frame(spark, "games", [dated("G", "JAX", "SF", date(2026, 1, 4))])
    assert [r.ticker for r in ingest.event_ticker_candidates(games).orderBy("pos").collect()] == [
        "KXNFLGAME-26JAN04JAXSF",
        "KXNFLGAME-26JAN04JACSF",
        "KXNFLGAME-26JAN05JAXSF",
        "KXNFLGAME-26JAN05JACSF",
    ]


def test_override_replaces_all_tickers(spark):
    games = frame(spark, "games", [dated("2025_22_SEA_NE", "SEA", "NE", date(2026, 2, 8))])
    assert rows(ingest.event_ticker_candidates(games)) == [("2025_22_SEA_NE", 0, "KXSB-26")]


def run(spark, games, lists):
    games = frame(spark, "games", games)
    landed = landed_markets(spark, lists)
    resolved = ingest.resolve_event_ticker(ingest.event_ticker_candidates(games), landed)
    winners = ingest.select_winner_market(landed, resolved, games)
    return resolved, winners, ingest.failed_games_report(games, landed)


def test_winner_market_is_the_first_that_fits(spark):
    event = "KXNFLGAME-25SEP08JACSF"
    resolved, winners, failed = run(
        spark,
        [dated("G", "JAX", "SF", date(2025, 9, 7))],
        [
            ("KXNFLGAME-25SEP07JAXSF", []),
            (
                event,
                [
                    listed(f"{event}-SPR", "Jacksonville WIN by spread"),
                    listed("OTHER-KC", "Kansas City wins"),
                    listed(f"{event}-JAC", "Will Jacksonville Win?"),
                    listed(f"{event}-SF", "Will San Francisco win?"),
                ],
            ),
        ],
    )
    assert rows(resolved) == [("G", event)]
    assert rows(winners.select("market_ticker", "close_time")) == [
        (f"{event}-JAC", "2025-09-08T00:30:00Z")
    ]
    assert rows(ingest.market_target_team(winners).select("target_team")) == [("JAX",)]
    assert rows(failed) == []


def test_failures_name_the_reason_and_what_was_tried(spark):
    event = "KXNFLGAME-25SEP07DALPHI"
    _, winners, failed = run(
        spark,
        [
            dated("G1", "DAL", "PHI", date(2025, 9, 7)),
            dated("G2", "KC", "LAC", date(2025, 9, 7)),
        ],
        [(event, [listed(f"{event}-X", "Total points")])],
    )
    assert rows(winners) == []
    assert sorted(rows(failed)) == [
        ("G1", "no winner market", event),
        ("G2", "no markets found", "KXNFLGAME-25SEP07KCLAC, KXNFLGAME-25SEP08KCLAC"),
    ]


def test_event_landed_twice_gives_one_market(spark):
    event = "KXNFLGAME-25SEP07DALPHI"
    _, winners, failed = run(
        spark,
        [dated("G", "DAL", "PHI", date(2025, 9, 7))],
        [
            (event, [listed(f"{event}-X", "Total points")]),
            (event, [listed(f"{event}-DAL", "Dallas to win")]),
        ],
    )
    assert rows(winners.select("market_ticker")) == [(f"{event}-DAL",)]
    assert rows(failed) == []


def test_candles(spark):
    payload = json.dumps(
        {
            "candlesticks": [
                {
                    "end_period_ts": 1757264400,
                    "price": {"open": "0.51", "high": "0.55", "low": None, "close": ""},
                    "volume": "12.75",
                },
                {"end_period_ts": 1762063200, "price": {}},
                {"end_period_ts": 1762063260, "volume": "3"},
            ]
        }
    )
    landed = spark.createDataFrame([("M", payload), ("N", "{}")], schemas.LANDED_CANDLES)
    found = ingest.flatten_candles(landed).drop("end_period_ts").orderBy("datetime_utc")
    assert rows(found) == [
        ("M", datetime(2025, 9, 7, 13), 0.51, 0.55, 0.0, 0.0, 12),
        # Clocks went back that morning: 06:00 UTC is the second 01:00.
        ("M", datetime(2025, 11, 2, 1), 0.0, 0.0, 0.0, 0.0, 0),
        ("M", datetime(2025, 11, 2, 1, 1), 0.0, 0.0, 0.0, 0.0, 3),
    ]


def test_candle_window_includes_both_ends(spark):
    close = 1757291400  # 2025-09-08T00:30:00Z
    stamps = [close - 14401, close - 14400, close, close + 1]
    payload = json.dumps({"candlesticks": [{"end_period_ts": s, "volume": "1"} for s in stamps]})
    landed = spark.createDataFrame([("M", payload)], schemas.LANDED_CANDLES)
    winners = spark.createDataFrame(
        [("M", "2025-09-08T00:30:00Z")], "market_ticker string, close_time string"
    )
    kept = ingest.candle_window(ingest.flatten_candles(landed), winners)
    assert kept.columns == schemas.PRICES.fieldNames()
    assert sorted(r.datetime_utc for r in kept.collect()) == [
        datetime(2025, 9, 7, 16, 30),
        datetime(2025, 9, 7, 20, 30),
    ]


def raw_play(**given):
    names = schemas.RAW_PLAY_BY_PLAY.fieldNames()
    base = dict(
        game_id="G",
        season=2025,
        week=1,
        home_team="H",
        away_team="A",
        game_date="2025-09-07",
        play_id=40.0,
        qtr=1.0,
        down=None,
        desc="(15:00) kick, \"deep\"",
        time_of_day="2025-09-07T17:02:03.500Z",
    )
    return tuple({**base, **given}.get(n) for n in names)


def test_games_and_plays(spark):
    raw = spark.createDataFrame(
        [raw_play(), raw_play(play_id=55.0, down=2.0), raw_play(play_id=60.0, time_of_day=None)],
        schemas.RAW_PLAY_BY_PLAY,
    )
    assert rows(ingest.build_games(raw)) == [("G", 2025, 1, date(2025, 9, 7), "H", "A")]
    plays = ingest.build_plays(raw)
    assert plays.schema.simpleString() == schemas.PLAYS.simpleString()
    assert [(p.play_id, p.down, p.timestamp_utc) for p in plays.orderBy("play_id").collect()] == [
        (40, None, datetime(2025, 9, 7, 17, 2, 3, 500000)),
        (55, 2, datetime(2025, 9, 7, 17, 2, 3, 500000)),
    ]


def test_teams(spark):
    games = frame(spark, "games", [game("1", "LA", "ZZ"), game("2", "ZZ", "KC")])
    assert sorted(rows(ingest.build_teams(games))) == [
        ("KC", "Kansas City Chiefs"),
        ("LA", "Los Angeles Rams"),
        ("ZZ", "ZZ"),
    ]


def test_only_new_and_forced_games_are_taken(spark):
    games = frame(spark, "games", [game("G1"), game("G2"), game("G3")])
    markets = frame(spark, "kalshi_markets", [market("M1", "G1"), market("M2", "G2")])
    assert rows(ingest.incremental_new_games(games, markets).select("game_id")) == [("G3",)]
    forced = ingest.incremental_new_games(games, markets, force=["G2"])
    assert sorted(rows(forced.select("game_id"))) == [("G2",), ("G3",)]


def test_known_tickers_are_not_added_again(spark):
    existing = frame(spark, "kalshi_markets", [market("M1", "G1")])
    new = frame(
        spark, "kalshi_markets", [market("M1", "G9"), market("M2", "G3"), market("M2", "G2")]
    )
    both = ingest.append_markets(existing, new)
    assert sorted(rows(both.select("market_ticker", "game_id"))) == [("M1", "G1"), ("M2", "G2")]

    price = dict(datetime_utc=datetime(2025, 9, 7), kalshi_close=0.5)
    stored = frame(spark, "kalshi_prices", [dict(price, market_ticker="M1")])
    fetched = frame(spark, "kalshi_prices", [dict(price, market_ticker=m) for m in ("M1", "M2")])
    added = ingest.unknown_markets(existing, new)
    appended = ingest.append_prices(stored, added, fetched)
    assert sorted(r.market_ticker for r in appended.collect()) == ["M1", "M2"]


def test_whole_ingest_and_its_increment(spark):
    event = "KXNFLGAME-25SEP07DALPHI"
    other = "KXNFLGAME-25SEP07KCLAC"
    raw = spark.createDataFrame(
        [
            raw_play(game_id="G1", home_team="PHI", away_team="DAL"),
            raw_play(game_id="G2", home_team="LAC", away_team="KC"),
            raw_play(game_id="G3", home_team="GB", away_team="CHI"),
        ],
        schemas.RAW_PLAY_BY_PLAY,
    )
    close = 1757291400  # 2025-09-08T00:30:00Z

    def candles(ticker):
        price = {"open": "0.5", "high": "0.6", "low": "0.4", "close": "0.55"}
        payload = {
            "candlesticks": [
                {"end_period_ts": close - 60, "price": price, "volume": "3"},
                {"end_period_ts": close - 20000, "price": price, "volume": "3"},
            ]
        }
        return ticker, json.dumps(payload)

    landed_candles = spark.createDataFrame(
        [candles(f"{event}-DAL"), candles(f"{other}-KC")], schemas.LANDED_CANDLES
    )
    first = [(event, [listed(f"{event}-DAL", "Dallas to win")])]
    tables, failed = ingest.build_tables(raw, landed_markets(spark, first), landed_candles)
    assert tables.plays.count() == 3
    assert sorted(r.team_abbr for r in tables.teams.collect()) == [
        "CHI", "DAL", "GB", "KC", "LAC", "PHI",
    ]
    assert rows(tables.markets) == [(f"{event}-DAL", "G1", "DAL", "Dallas to win")]
    assert rows(tables.prices) == [
        (f"{event}-DAL", datetime(2025, 9, 7, 20, 29), 0.5, 0.6, 0.4, 0.55, 3)
    ]
    assert sorted(r.game_id for r in failed.collect()) == ["G2", "G3"]

    both = first + [(other, [listed(f"{other}-KC", "Kansas City to win")])]
    again, failed = ingest.build_tables(
        raw, landed_markets(spark, both), landed_candles, existing=tables, force=["G1"]
    )
    assert sorted(r.market_ticker for r in again.markets.collect()) == [
        f"{event}-DAL", f"{other}-KC",
    ]
    assert again.prices.count() == 2
    assert [r.game_id for r in failed.collect()] == ["G3"]


def test_unreadable_responses_are_told_apart(spark):
    event = "KXNFLGAME-25SEP07DALPHI"
    games = frame(spark, "games", [{**game("G1", "PHI", "DAL"), "game_date": date(2025, 9, 7)},
                                   {**game("G2", "GB", "CHI"), "game_date": date(2025, 9, 7)}])
    landed = spark.createDataFrame([(event, '{"markets": [{"ticker": "x'), (event, None)], schemas.LANDED_MARKETS)
    reasons = {r["game_id"]: r["reason"] for r in ingest.failed_games_report(games, landed).collect()}
    assert reasons == {"G1": "unreadable response", "G2": "no markets found"}
    pages = spark.createDataFrame([("M", '{"candlesticks": [{"end_')], schemas.LANDED_CANDLES)
    assert ingest.flatten_candles(pages).count() == 0
    assert ingest.rejected_payloads(landed, pages).count() == 3


def test_page_landed_twice_gives_each_candle_once(spark):
    price = {"open": "0.5", "high": "0.6", "low": "0.4", "close": "0.55"}
    page = json.dumps({"candlesticks": [{"end_period_ts": 60 * i, "price": price, "volume": "3"} for i in range(4)]})
    landed = spark.createDataFrame([("M", page), ("M", page), ("N", page)], schemas.LANDED_CANDLES)
    assert ingest.unique_candles(ingest.flatten_candles(landed)).count() == 8
    winners = spark.createDataFrame([("M", "1970-01-01T00:02:00Z")], "market_ticker string, close_time string")
    windowed = ingest.landed_window(landed, winners)
    assert windowed.count() == 3 and windowed.columns == schemas.PRICES.fieldNames()


def test_increment_keeps_earlier_games_whole(spark):
    raw = lambda *games: spark.createDataFrame(
        [raw_play(game_id=g, home_team=h, away_team=a) for g, h, a in games], schemas.RAW_PLAY_BY_PLAY
    )
    none = landed_markets(spark, []), spark.createDataFrame([], schemas.LANDED_CANDLES)
    first, _ = ingest.build_tables(raw(("G1", "PHI", "DAL")), *none)
    both, _ = ingest.build_tables(raw(("G2", "GB", "DAL")), *none, existing=first)
    assert sorted(r.game_id for r in both.games.collect()) == ["G1", "G2"]
    assert sorted(r.game_id for r in both.plays.collect()) == ["G1", "G2"]
    assert sorted(r.team_abbr for r in both.teams.collect()) == ["DAL", "GB", "PHI"]
    delta, failed = ingest.build_increment(raw(("G2", "GB", "DAL")), *none, existing=first)
    assert [r.team_abbr for r in delta.teams.collect()] == ["GB"]
    assert sorted(r.game_id for r in failed.collect()) == ["G1", "G2"]


def test_candles_of_an_increment_are_joined_once(spark):
    """Pages meet the small side alone, before their candles are rows."""
    landed = spark.createDataFrame([("M", "{}")], schemas.LANDED_CANDLES)
    winners = spark.createDataFrame([("M", "x")], "market_ticker string, close_time string")
    plan = ingest.landed_window(landed, winners)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Generate") < plan.index("Join")


def test_first_landed_list_wins(spark):
    event = "KXNFLGAME-25SEP07DALPHI"
    games = frame(spark, "games", [{**game("G1", "PHI", "DAL"), "game_date": date(2025, 9, 7)}])
    lists = [(event, [listed(f"{event}-PHI", "PHI to win")]), (event, [listed(f"{event}-DAL", "DAL to win")])]
    landed = landed_markets(spark, lists)
    resolved = ingest.resolve_event_ticker(ingest.event_ticker_candidates(games), landed)
    found = ingest.select_winner_market(landed, resolved, games).first()
    assert found["market_ticker"] == f"{event}-DAL"  # no order known: the smallest
    dated = landed.withColumn("landed_at", F.when(F.col("payload").contains("PHI to win"), 1).otherwise(2))
    found = ingest.select_winner_market(dated, resolved, games).first()
    assert found["market_ticker"] == f"{event}-PHI"
