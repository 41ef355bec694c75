"""States that merge, bitmaps of keys, and reports as table functions."""

import random
from datetime import date, timedelta

import pytest
from build import at, game, market, play, price, rows, tables
from fourthtick.operators import distinct
from fourthtick.plans import reports, routes, summaries, views
from pyspark.sql import functions as F


def drawn(spark, seed):
    draw = random.Random(seed)
    prices, used = [], set()
    for _ in range(200):
        ticker, when = f"M{draw.randrange(4)}", at(13) + timedelta(minutes=draw.randrange(600))
        if (ticker, when) not in used:
            used.add((ticker, when))
            prices.append(price(draw.choice([when, when, when, when, None]), draw.choice([0.0, 0.2, 0.7, None]), ticker))
    plays = [
        play(k, draw.choice([1, 2, 4, None]), draw.choice([900.0, 30.0, 5.0, None]), (draw.randrange(30), 7),
             draw.choice([None, 0.3, 0.8]), at(17), f"G{draw.randrange(3)}")
        for k in range(150)
    ]
    games = [game(f"G{k}", f"H{k}", f"A{k}") for k in range(3)]
    markets = [market(f"M{k}", f"G{k % 3}", f"H{k % 3}") for k in range(4)]
    return tables(spark, games=games, plays=plays, markets=markets, prices=prices)


def test_states_of_increments_equal_facts_of_all(spark, tmp_path):
    t = drawn(spark, 3)
    folder = str(tmp_path / "states")
    part = lambda df, k: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == k)
    for k in (0, 1, 2, 1):
        increment = views.replace(t, prices=part(t.prices, k), plays=part(t.plays, k))
        summaries.add_states(increment, folder, f"part-{k}")
    merged, whole = summaries.with_states(t, folder), views.with_facts(t)
    for name in ("market_facts", "play_facts"):
        got, want = getattr(merged, name), getattr(whole, name)
        assert got.dtypes == want.dtypes
        assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)
    summaries.compact_states(spark, folder, str(tmp_path / "compact"))
    again = summaries.with_states(t, str(tmp_path / "compact"))
    assert sorted(rows(again.play_facts), key=repr) == sorted(rows(whole.play_facts), key=repr)
    for report in (reports.market_bias, reports.adversity_performance, reports.vegas_vs_market):
        assert rows(report(merged)) == rows(report(t))


def test_merging_reads_no_candles(spark, tmp_path):
    t = drawn(spark, 4)
    summaries.add_states(t, str(tmp_path))
    t.prices.write.parquet(f"{tmp_path}/kalshi_prices")
    stored = views.replace(t, prices=spark.read.parquet(f"{tmp_path}/kalshi_prices"))
    merged = summaries.with_states(stored, str(tmp_path))
    files = reports.accuracy_by_week(merged).inputFiles()
    assert any("market_states" in f for f in files)
    assert not any("kalshi_prices" in f for f in files)


def test_sets_of_keys_are_exact_and_merge(spark, tmp_path):
    draw = random.Random(6)
    data = [(draw.randrange(5), f"key{draw.randrange(70_000)}") for _ in range(90_000)] + [(9, None), (9, "one")]
    frame = spark.createDataFrame(data, "part int, key string").repartition(6)
    first = distinct.numbered(frame.where("part < 3"), "key")
    numbers = distinct.numbered(frame, "key", first)
    assert numbers.count() == numbers.select("number").distinct().count() == len({k for _, k in data if k})
    kept = numbers.join(first, ["key", "number"]).count()
    assert kept == first.count()
    folder = str(tmp_path / "sets")
    for half in (0, 1):
        some = frame.where(F.pmod(F.xxhash64("key", "part"), F.lit(2)) == half)
        distinct.key_sets(some, "part", "key", numbers).write.mode("append").parquet(folder)
    sets = spark.read.parquet(folder)
    each = {p: len({k for q, k in data if q == p and k}) for p in {p for p, _ in data}}
    assert dict(rows(distinct.set_sizes(sets, "part"))) == each
    assert rows(distinct.set_sizes(sets)) == [(len({k for _, k in data if k}),)]
    assert rows(distinct.set_sizes(sets.where("false"))) == [(0,)]


def test_overlap_by_day(spark):
    t = tables(
        spark,
        games=[game("G1"), game("G2")],
        markets=[market("M1", "G1"), market("M2", "G2")],
        plays=[play(1, at=at(17), game_id="G1"), play(2, at=at(17, day=8), game_id="G1"), play(3, at=at(17), game_id="G2")],
        # Candles carry New York clocks: 13:05 is 17:05 in UTC.
        prices=[price(at(13, 5), 0.5, "M1"), price(at(13, 5, day=8), 0.5, "M1"), price(at(13, 11), 0.5, "M2")],
    )
    sets = reports.overlap_sets(t, distinct.numbered(t.games, "game_id"))
    assert rows(reports.overlap_by_day(sets)) == [(date(2025, 9, 7), 1), (date(2025, 9, 8), 1), (None, 1)]


@pytest.fixture
def published(spark):
    t = drawn(spark, 5)
    routes.publish_functions(t, "r_")
    return t


def test_functions_bind_their_parameters(spark, published):
    t = published
    sql = lambda text, **args: sorted(rows(spark.sql(text, args=args)), key=repr)
    same = lambda df: sorted(rows(df), key=repr)
    assert sql("SELECT * FROM r_market_bias(:n)", n=1) == same(reports.market_bias(t, 1))
    assert sql("SELECT * FROM r_market_swings(top => 2)") == same(reports.market_swings(t, 2))
    assert sql("SELECT * FROM r_market_swings()") == same(reports.market_swings(t))
    assert sql("SELECT * FROM r_favorite_win_rate(0.99)") == same(reports.favorite_win_rate(t, 0.99))
    assert sql("SELECT * FROM r_underdog_win_rate(-1)") == same(reports.underdog_win_rate(t, -1))
    for size in (2, 9):
        want = same(reports.early_hype_fade(t, -1.0, size))
        assert want and sql("SELECT * FROM r_early_hype_fade(-1, :w)", w=size) == want
    # A function joins like a table, and a text is no way into the statement.
    joined = spark.sql("SELECT b.num_games, g.week FROM r_market_bias(0) b JOIN r_games g ON g.home_team = b.target_team")
    assert joined.count() == len(rows(reports.market_bias(t, 0)))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|DATATYPE_MISMATCH"):
        spark.sql("SELECT * FROM r_market_bias(:n)", args={"n": "1) UNION SELECT 1"}).collect()
