"""Increments that may be stored again."""

import pytest
from build import at, game, market, play, price, rows, tables
from fourthtick.operators import quality
from fourthtick.sources import storage


def named(t):
    return {name: sorted(rows(df), key=repr) for name, df in t.named().items()}


def part(spark, n):
    return tables(
        spark,
        teams=[dict(team_abbr=f"H{n}", team_name="Home"), dict(team_abbr=f"A{n}", team_name="Away")],
        games=[game(f"G{n}", f"H{n}", f"A{n}")],
        plays=[play(1, game_id=f"G{n}", at=at(17)), play(2, game_id=f"G{n}")],
        markets=[market(f"M{n}", f"G{n}", f"H{n}")],
        prices=[price(at(13, k), 0.5, f"M{n}") for k in range(3)],
    )


def test_an_increment_stored_again_replaces_itself(spark, tmp_path):
    folder = str(tmp_path)
    storage.save_tables(part(spark, 0), folder)
    storage.save_increment(part(spark, 1), folder, "2025-09-07")
    once = named(storage.open_tables(spark, folder))
    assert len(once["kalshi_prices"]) == 6
    storage.save_increment(part(spark, 1), folder, "2025-09-07")
    again = storage.open_tables(spark, folder)
    assert named(again) == once
    assert {r["violations"] for r in quality.check_keys(again).collect()} == {0}
    storage.save_increment(part(spark, 2), folder, "2025-09-08")
    assert len(named(storage.open_tables(spark, folder))["plays"]) == 6
    with pytest.raises(Exception, match="already exists"):
        storage.save_tables(part(spark, 0), folder)


def test_a_failed_attempt_does_not_count_as_known(spark, tmp_path):
    folder = str(tmp_path)
    storage.save_tables(part(spark, 0), folder)
    # Two of five tables were written when the attempt ended.
    for name in ("teams", "games"):
        part(spark, 1).named()[name].write.parquet(f"{folder}/{name}/increment=second")
    assert "G1" in {r["game_id"] for r in storage.open_tables(spark, folder).games.collect()}
    before = storage.open_tables(spark, folder, without="second")
    assert named(before) == named(part(spark, 0))
    assert before.prices.schema == storage.open_tables(spark, folder).prices.schema
    storage.save_increment(part(spark, 1), folder, "second")
    both = named(storage.open_tables(spark, folder))
    assert both == {k: sorted(v + named(part(spark, 0))[k], key=repr) for k, v in named(part(spark, 1)).items()}


def test_names_of_increments(spark, tmp_path):
    for name in ("base", "a/b", "", "x=1"):
        with pytest.raises(ValueError, match="not a name"):
            storage.save_increment(part(spark, 0), str(tmp_path), name)
