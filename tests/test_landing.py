"""Landed files taken in once, by a stream."""

import json

import pytest
from build import rows
from fourthtick import schemas
from fourthtick.plans import ingest, landing
from fourthtick.sources import storage

SETTINGS = {"team_names": {}, "overrides": {}, "market_codes": {}, "prefix": "E-"}


def lands(spark, folder, game, kinds, candles=3):
    """Files of one game: plays, the market list of its event, candles of its winner market."""
    event = f"E-25SEP07A{game}H{game}"
    ticker = f"{event}-H{game}"
    if "play_by_play" in kinds:
        raw = schemas.RAW_PLAY_BY_PLAY
        row = {"game_id": f"G{game}", "home_team": f"H{game}", "away_team": f"A{game}", "game_date": "2025-09-07",
               "season": 2025, "week": 1, "qtr": 1.0, "time_of_day": "2025-09-07T17:00:00Z"}
        plays = [tuple({**row, "play_id": float(k)}.get(c) for c in raw.fieldNames()) for k in range(2)]
        spark.createDataFrame(plays, raw).write.mode("append").parquet(f"{folder}/play_by_play")
    if "markets" in kinds:
        listing = {"markets": [{"ticker": ticker, "title": "H win", "close_time": "2025-09-07T21:00:00Z"}]}
        body = spark.createDataFrame([(event, json.dumps(listing))], schemas.LANDED_MARKETS)
        body.write.mode("append").json(f"{folder}/markets")
    if "candles" in kinds:
        close = 1757278800  # 2025-09-07T21:00:00Z
        page = [{"end_period_ts": close - 60 * k, "price": {"close": "0.5"}, "volume": "1"} for k in range(candles)]
        body = spark.createDataFrame([(ticker, json.dumps({"candlesticks": page}))], schemas.LANDED_CANDLES)
        body.write.mode("append").json(f"{folder}/candles")


EVERYTHING = ("play_by_play", "markets", "candles")


def named(t):
    return {name: sorted(rows(df), key=repr) for name, df in t.named().items()}


def at_once(spark, folder):
    t, _ = ingest.build_tables(
        storage.read_play_by_play(spark, f"{folder}/play_by_play"),
        storage.read_landed_markets(spark, f"{folder}/markets"),
        storage.read_landed_candles(spark, f"{folder}/candles"),
        **SETTINGS,
    )
    return {name: sorted(rows(df.select(*schemas.TABLES[name].fieldNames())), key=repr) for name, df in t.named().items()}


def test_new_files_only_and_the_same_as_one_batch(spark, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "landed"), str(tmp_path / "store")
    seen = []
    add = landing.add_files
    monkeypatch.setattr(landing, "add_files", lambda spark, paths, *a, **k: (seen.append(paths), add(spark, paths, *a, **k)))
    lands(spark, folder, 1, EVERYTHING)
    lands(spark, folder, 2, ("play_by_play",))
    assert landing.take_in(spark, folder, store, **SETTINGS) == 1
    assert named(storage.open_tables(spark, store))["kalshi_markets"][0][1] == "G1"
    # Of the second game the list comes now; of the third, candles and list come before the plays.
    lands(spark, folder, 2, ("markets", "candles"))
    lands(spark, folder, 3, ("candles",))
    assert landing.take_in(spark, folder, store, **SETTINGS) == 1
    lands(spark, folder, 3, ("markets",))
    assert landing.take_in(spark, folder, store, **SETTINGS) == 1
    lands(spark, folder, 3, ("play_by_play",))
    assert landing.take_in(spark, folder, store, **SETTINGS) == 1
    assert landing.take_in(spark, folder, store, **SETTINGS) == 0
    got = named(storage.open_tables(spark, store))
    assert got == at_once(spark, folder)
    assert [len(got[n]) for n in ("games", "plays", "kalshi_markets", "kalshi_prices")] == [3, 6, 3, 9]
    # No file was handed over twice.
    names = [path for paths in seen for path in paths]
    assert len(names) == len(set(names)) and len(seen) == 4


def test_a_call_that_ended_half_way_is_made_anew(spark, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "landed"), str(tmp_path / "store")
    lands(spark, folder, 1, EVERYTHING)
    landing.take_in(spark, folder, store, **SETTINGS)
    lands(spark, folder, 2, EVERYTHING)

    def ends_early(tables, folder, increment):
        for name in ("teams", "games", "kalshi_markets"):
            tables.named()[name].write.parquet(f"{folder}/{name}/increment={increment}")
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patched:
        patched.setattr(storage, "save_increment", ends_early)
        with pytest.raises(Exception, match="driver is gone"):
            landing.take_in(spark, folder, store, **SETTINGS)
    assert len(rows(storage.open_tables(spark, store).games)) == 2  # a market without candles by now
    assert landing.take_in(spark, folder, store, **SETTINGS) == 1
    assert named(storage.open_tables(spark, store)) == at_once(spark, folder)


def test_nothing_landed(spark, tmp_path):
    folder, store = tmp_path / "landed", str(tmp_path / "store")
    for kind in landing.FOLDERS:
        (folder / kind).mkdir(parents=True)
    assert landing.take_in(spark, str(folder), store, **SETTINGS) == 0
    assert {name: len(r) for name, r in named(storage.open_tables(spark, store)).items()} == dict.fromkeys(schemas.TABLES, 0)
