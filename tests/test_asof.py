import random
from datetime import datetime, timedelta

from build import rows
from fourthtick.functions.times import epoch_seconds, from_epoch_seconds, utc_to_wall, wall_to_utc
from fourthtick.operators.asof import asof_backward, within_interval
from fourthtick.operators.ranking import rank_by_time
from fourthtick.operators.slices import in_slices, slice_borders
from pyspark.sql import functions as F

START = datetime(2025, 9, 7, 12)


def moments(spark, values, names):
    schema = f"k string, {names[0]} timestamp_ntz, {names[1]} int"
    return spark.createDataFrame(values, schema)


def match(spark, left, right, tolerance, **more):
    found = asof_backward(
        moments(spark, left, ("t", "id")),
        moments(spark, right, ("rt", "v")),
        by="k",
        left_time="t",
        right_time="rt",
        values=["v"],
        tolerance=tolerance,
        **more,
    )
    return sorted(rows(found.select("id", "v")))


def test_both_ends_of_the_tolerance_match(spark):
    two = timedelta(minutes=2)
    assert match(spark, [("a", START, 1)], [("a", START, 7)], two) == [(1, 7)]
    assert match(spark, [("a", START, 1)], [("a", START - two, 7)], two) == [(1, 7)]
    just_before = START - two - timedelta(microseconds=1)
    assert match(spark, [("a", START, 1)], [("a", just_before, 7)], two) == []
    just_after = START + timedelta(microseconds=1)
    assert match(spark, [("a", START, 1)], [("a", just_after, 7)], two) == []


def test_match_reaches_over_a_slice_boundary(spark):
    noon = datetime(2025, 9, 7, 12)
    before = noon - timedelta(seconds=1, microseconds=500)
    assert match(spark, [("a", noon, 1)], [("a", before, 7)], timedelta(minutes=2)) == [(1, 7)]


def test_other_keys_and_missing_times_do_not_match(spark):
    left = [("a", START, 1), ("b", None, 2)]
    right = [("c", START, 7), ("b", START, 8)]
    assert match(spark, left, right, timedelta(minutes=2)) == []


def test_null_value_of_the_latest_row_is_kept(spark):
    right = [("a", START - timedelta(seconds=5), 7), ("a", START, None)]
    assert match(spark, [("a", START, 1)], right, timedelta(minutes=2)) == [(1, None)]


def random_case(seed, hot):
    """Rows of few keys; with ``hot`` one key holds most rows in a short time."""
    pick = random.Random(seed)

    def some(n, base):
        out, used = [], set()
        while len(out) < n:
            key = "hot" if hot and pick.random() < 0.6 else pick.choice("abcd")
            t = START + timedelta(seconds=pick.randrange(6 * 3600), microseconds=pick.randrange(10**6))
            if (key, t) not in used:
                used.add((key, t))
                out.append((key, t, base + len(out)))
        return out

    return some(300, 0), some(400, 10_000)


def test_equals_brute_force(spark):
    for seed, hot, tolerance, size in [
        (1, False, timedelta(minutes=2), 10**6),
        (2, True, timedelta(minutes=2), 40),
        (3, True, timedelta(seconds=90.5), 5),
        (4, True, timedelta(hours=6), 150),
    ]:
        left, right = random_case(seed, hot)
        expected = []
        for key, t, ident in left:
            near = [r for r in right if r[0] == key and t - tolerance <= r[1] <= t]
            if near:
                expected.append((ident, max(near, key=lambda r: r[1])[2]))
        assert match(spark, left, right, tolerance, slice_rows=size) == sorted(expected)


def test_interval_equals_brute_force(spark):
    tolerance = timedelta(minutes=1)
    left, right = random_case(5, True)
    expected = sorted(
        ident
        for key, t, ident in left
        if any(r[0] == key and abs(r[1] - t) <= tolerance for r in right)
    )
    found = within_interval(
        moments(spark, left, ("t", "id")),
        moments(spark, right, ("rt", "v")),
        by="k",
        left_time="t",
        right_time="rt",
        tolerance=tolerance,
    )
    assert sorted(r.id for r in found.collect()) == expected
    assert found.columns == ["k", "t", "id"]


def test_rank_equals_sorted_position_for_a_hot_key(spark):
    _, right = random_case(6, True)
    right += [(None, START, -1), ("hot", None, -2), (None, None, -3)]
    expected = []
    for key in {r[0] for r in right}:
        times = sorted((r for r in right if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        expected += [(r[2], i + 1) for i, r in enumerate(times)]
    for size in (10**6, 20):
        ranked = rank_by_time(moments(spark, right, ("rt", "v")), "k", "rt", "rn", slice_rows=size)
        assert sorted(rows(ranked.select("v", "rn"))) == sorted(expected)
        assert dict(ranked.dtypes)["rn"] == "bigint"


def test_a_key_within_one_hour_is_cut_into_even_slices(spark):
    draw = random.Random(9)
    # Nearly all within a second, a few before and after, and one key that needs no slices.
    times = [START + timedelta(microseconds=draw.randrange(10**6)) for _ in range(20_000)]
    times += [START - timedelta(minutes=1), START + timedelta(minutes=50)]
    frame = moments(spark, [("hot", t, i) for i, t in enumerate(times)] + [("b", START, 0)], ("rt", "v"))
    borders = slice_borders([frame], "k", "rt", slice_rows=1000)
    assert [r["k"] for r in borders.collect()] == ["hot"]
    sizes = rows(in_slices(frame.where("k = 'hot'"), borders, "k", "rt").groupBy("_slice").count())
    assert len(sizes) >= 20 and max(n for _, n in sizes) < 1300
    assert slice_borders([frame], "k", "rt", slice_rows=30_000) is None
    # Both sides count towards a key's size.
    assert slice_borders([frame, frame], "k", "rt", slice_rows=30_000) is not None


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "t timestamp_ntz").select(build(F.col("t")))
    return df.first()[0]


def test_utc_to_eastern_follows_daylight_saving(spark):
    assert one(spark, datetime(2025, 11, 2, 5, 30), utc_to_wall) == datetime(2025, 11, 2, 1, 30)
    assert one(spark, datetime(2025, 11, 2, 6, 30), utc_to_wall) == datetime(2025, 11, 2, 1, 30)
    assert one(spark, datetime(2025, 3, 9, 7, 0), utc_to_wall) == datetime(2025, 3, 9, 3, 0)


def test_eastern_to_utc_reads_the_doubled_hour_as_standard_time(spark):
    cases = {
        datetime(2025, 7, 1, 12): datetime(2025, 7, 1, 16),
        datetime(2025, 12, 1, 12): datetime(2025, 12, 1, 17),
        datetime(2025, 11, 2, 0, 30): datetime(2025, 11, 2, 4, 30),
        datetime(2025, 11, 2, 1, 30): datetime(2025, 11, 2, 6, 30),
        datetime(2025, 11, 2, 2, 30): datetime(2025, 11, 2, 7, 30),
        # The hour that spring skips is read with the offset before the change.
        datetime(2025, 3, 9, 2, 30): datetime(2025, 3, 9, 7, 30),
        datetime(2025, 3, 9, 1, 30): datetime(2025, 3, 9, 6, 30),
    }
    for wall, utc in cases.items():
        assert one(spark, wall, wall_to_utc) == utc


def test_epoch_seconds_ignore_the_session_zone(spark):
    moment = datetime(2025, 3, 9, 2, 30, 15)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, moment, epoch_seconds) == 1741487415
            assert one(spark, moment, lambda t: from_epoch_seconds(epoch_seconds(t))) == moment
            assert one(spark, datetime(1969, 12, 31, 23, 59, 58), epoch_seconds) == -2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_null_keys_match_nothing_and_tolerance_spans_many_slices(spark):
    """Brute force with NULL keys and times, and a tolerance of several slices."""
    draw = random.Random(12)
    start = datetime(2024, 1, 1)

    def some_rows(n, value):
        return [
            (
                draw.choice(["a", "b", None]),
                draw.choice([start + timedelta(minutes=draw.randrange(3000)), None]),
                value + i,
            )
            for i in range(n)
        ]

    left, right = some_rows(120, 0), some_rows(60, 1000)
    tolerance = timedelta(hours=6)
    expected = []
    for key, at, number in left:
        fits = [
            (t, v)
            for k, t, v in right
            if key is not None and k == key and at and t and at - tolerance <= t <= at
        ]
        if fits:
            latest = max(t for t, _ in fits)
            expected.append((number, {v for t, v in fits if t == latest}))
    for size in (10**6, 9):
        found = asof_backward(
            spark.createDataFrame(left, "k string, t timestamp_ntz, number int"),
            spark.createDataFrame(right, "k string, u timestamp_ntz, v int"),
            by="k",
            left_time="t",
            right_time="u",
            values=["v"],
            tolerance=tolerance,
            slice_rows=size,
        ).collect()
        got = {r["number"]: r["v"] for r in found}
        assert len(found) == len(expected) and got.keys() == {n for n, _ in expected}
        assert all(got[n] in values for n, values in expected)
