"""One user with a third of all events: results stay exact and work stays spread."""

import pytest
from compare import connect, rows_of

import __spark_entry__ as entry
from fixtures.queries import QUERIES
from pyspark.sql import functions as F

QUERY_NAMES = [
    "pregame_prices",
    "adversity_performance",
    "volatility_comparison",
    "early_hype_fade",
    "score_vs_market",
    "timestamp_overlap",
    "summary_cards",
    "flatten_candles",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The smallest tables, with every third event moved to user 3."""
    source, target = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("skew"))
    events = spark.read.parquet(f"{source}/events.parquet")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(3).cast("long")).otherwise(F.col("user_id"))
    events.withColumn("user_id", hot).coalesce(1).write.parquet(f"{target}/events.parquet")
    spark.read.parquet(f"{source}/nation.parquet").write.parquet(f"{target}/nation.parquet")
    return target


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_results_are_exact_with_a_hot_user(spark, skewed, name):
    connection = connect("/nowhere")
    for table in ("events", "nation"):
        connection.execute(f"CREATE VIEW {table} AS FROM '{skewed}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, skewed)
    expected = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(
        columns, expected.fetchall()
    )
