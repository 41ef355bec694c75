"""What the physical plans must and must not contain."""

import contextlib

import pytest

import __spark_entry__ as entry
from fixtures.queries import QUERIES
from fixtures.relations import relations
from fourthtick.plans import reports, views
from fourthtick.sources import storage

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    storage.save_tables(relations(spark, SF_DIR), folder)
    return storage.open_tables(spark, folder)


@pytest.mark.parametrize("name", QUERIES)
def test_no_query_needs_a_cross_join_or_python_even_without_broadcasts(spark, name):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = plan(entry.queries()[name](spark, SF_DIR))
    for operator in ("Cartesian", "NestedLoop", "Broadcast", "Python", "Pandas", "MapInArrow"):
        assert operator not in text, operator


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(views.first_prices(stored))
    assert "GreaterThan(kalshi_close,0.0)" in text
    assert "struct<market_ticker:string,datetime_utc:timestamp_ntz,kalshi_close:double>" in text
    assert "EqualTo(target_team,H)" in plan(reports.team_market_history(stored, "h"))


def test_candles_are_hash_aggregated_before_any_shuffle(stored):
    for frame in (views.first_prices(stored), views.market_facts(stored)):
        text = plan(frame)
        assert "partial_min_by" in text and "SortAggregate" not in text


def test_first_and_last_candles_are_cut_before_the_shuffle(stored):
    text = plan(reports.early_hype_fade(stored))
    assert text.count("row_number(), 5, Partial") == 4  # twice in each direction


def test_adversity_reads_plays_once(stored):
    assert plan(reports.adversity_performance(stored)).count("/plays") == 1


def test_cards_read_candles_and_plays_once(stored):
    from fourthtick.plans import details

    text = plan(details.summary_cards(stored))
    assert text.count("/plays") == 1 and text.count("/kalshi_prices") == 1


def test_history_moves_only_candles_of_its_hours(spark, stored):
    newest = stored.prices.groupBy("market_ticker").count().orderBy("count").collect()[-1]
    team = stored.markets.where(f"market_ticker = '{newest['market_ticker']}'").first()["target_team"]
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = plan(reports.team_market_history(stored, team, limit=5))
        whole = plan(reports.team_market_history(stored, team, limit=10**6))
    # The candles are scanned once, and cut before anything is exchanged.
    assert text.count("/kalshi_prices") == 1 and "Window" not in text
    assert "GreaterThanOrEqual(datetime_utc," in text
    assert "GreaterThanOrEqual(datetime_utc," not in whole


def test_top_lists_do_not_sort_everything(stored):
    for frame in (reports.market_swings(stored), reports.team_market_history(stored, "H")):
        assert "TakeOrderedAndProject" in plan(frame)
