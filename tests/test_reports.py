from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from build import at, game, market, play, price, rows, tables
from fixtures.relations import relations
from fourthtick.functions.rounding import percent, round_half_up
from fourthtick.operators.combine import side_by_side, sort_any
from fourthtick.plans import details, reports
from pyspark.sql import functions as F


def season(spark, *entries, **more):
    """One game and market per (price, home score, away score[, week])."""
    games, markets, prices, plays = [], [], [], []
    for i, (close, home, away, *week) in enumerate(entries):
        games.append(game(f"G{i}", week=week[0] if week else 1))
        markets.append(market(f"M{i}", f"G{i}"))
        prices.append(price(at(13), close, f"M{i}"))
        plays.append(play(1, score=(home, away), wp=0.5, game_id=f"G{i}"))
    return tables(spark, games=games, markets=markets, prices=prices, plays=plays, **more)


def test_bias_drops_ties_and_small_teams(spark):
    t = season(spark, (0.6, 3, 0), (0.8, 0, 3), (0.9, 3, 3))
    assert rows(reports.market_bias(t, min_games=2)) == [("H", 2, 0.7, 0.5, 0.2)]
    assert rows(reports.market_bias(t, min_games=3)) == []


def test_weeks_outside_the_regular_season_are_left_out(spark):
    t = season(spark, (0.6, 3, 0, 0), (0.7, 3, 0, 1), (0.8, 3, 0, 18), (0.9, 3, 0, 19))
    assert [r.week for r in reports.accuracy_by_week(t).collect()] == [1, 18]
    assert [r.week for r in reports.vegas_vs_market(t).collect()] == [1, 18]


def test_tie_counts_as_lost_in_weekly_accuracy(spark):
    t = season(spark, (0.6, 3, 3))
    assert rows(reports.accuracy_by_week(t)) == [(1, 1, 0.6, 0.0, 0.6)]


def test_empty_input(spark):
    t = season(spark, (0.6, 3, 0))
    assert rows(reports.underdog_win_rate(t, 0.1)) == [(0, None, None)]
    assert rows(reports.favorite_win_rate(t, 0.9)) == [(0, 0.0, 0.0)]
    empty = tables(spark)
    assert rows(reports.underdog_win_rate(empty)) == [(0, None, None)]
    assert rows(reports.game_coverage(empty)) == [(0, 0, 0, 0, 0)]
    assert rows(details.coverage_pct(empty))[0][-1] is None
    assert rows(details.summary_cards(empty)) == [(0.0, 0, 0.0, 0, None, None)]
    assert rows(details.vegas_season_summary(empty)) == [(0, None, None, 0.0)]
    assert rows(reports.timestamp_overlap(empty)) == [(0, 0, None, None, None, None, 0)]


def test_limits_are_inclusive(spark):
    t = season(spark, (0.4, 3, 0), (0.5, 0, 3), (0.6, 3, 0), (0.8, 3, 0))
    assert rows(reports.underdog_win_rate(t, 0.4))[0][:2] == (1, 1.0)
    assert rows(reports.favorite_win_rate(t, 0.5))[0] == (3, 2.0, 0.667)
    assert [r.favorite_strength for r in reports.favorite_calibration(t).collect()] == [
        "moderate_favorite",
        "slight_favorite",
        "strong_favorite",
    ]


def test_swings_start_at_midnight_of_game_day_and_break_ties(spark):
    games = [game(g, game_date=date(2025, 9, 7)) for g in ("G1", "G2")]
    t = tables(
        spark,
        games=games,
        markets=[market("M2", "G2"), market("M1", "G1")],
        prices=[
            price(datetime(2025, 9, 6, 23, 59), 0.1, "M1"),
            price(datetime(2025, 9, 7), 0.4, "M1"),
            price(at(14), 0.0, "M1"),
            price(at(15), 0.6, "M1"),
            price(at(13), 0.6, "M2"),
            price(at(14), 0.4, "M2"),
        ],
    )
    found = rows(reports.market_swings(t).select("game_id", "min_price", "price_swing"))
    assert found == [("G1", 0.4, 0.2), ("G2", 0.4, 0.2)]
    assert rows(reports.market_swings(t, limit=1).select("game_id")) == [("G1",)]
    assert [r.severity for r in details.swing_severity(t).collect()] == ["medium", "medium"]


def adversity(spark, team, *wps, quarter=1, left=800.0):
    t = tables(
        spark,
        games=[game()],
        markets=[market(team=team)],
        prices=[price(at(13), 0.7)],
        plays=[play(1, wp=wps[0])]
        + [play(i + 2, quarter, left, wp=wp) for i, wp in enumerate(wps[1:])]
        + [play(99, qtr=4, left=0.0, score=(7, 0))],
    )
    return rows(reports.adversity_performance(t))


def test_adversity_is_seen_from_the_favorite(spark):
    assert adversity(spark, "H", 0.7, 0.4) == [(1, 1, 0.7, 1.0)]
    assert adversity(spark, "H", 0.7, 0.5) == [(0, 1, 0.7, 1.0)]
    assert adversity(spark, "A", 0.3, 0.6) == [(1, 1, 0.7, 0.0)]
    # The drop itself is still adversity.
    assert adversity(spark, "H", 0.75, 0.5) == [(1, 1, 0.7, 1.0)]


def test_adversity_ignores_the_last_two_minutes(spark):
    assert adversity(spark, "H", 0.7, 0.1, quarter=4, left=119.0) == [(0, 1, 0.7, 1.0)]
    assert adversity(spark, "H", 0.7, 0.1, quarter=4, left=120.0) == [(1, 1, 0.7, 1.0)]
    # Unknown time left in the fourth quarter is neither kept nor dropped for sure: dropped.
    assert adversity(spark, "H", 0.7, 0.1, quarter=4, left=None) == [(0, 1, 0.7, 1.0)]


def test_volatility_uses_all_markets_of_a_game(spark):
    t = tables(
        spark,
        games=[game()],
        plays=[play(1, score=(3, 0))],
        markets=[market("M1"), market("M2", team="A"), market("M3", team="A")],
        prices=[
            price(at(13), 0.6, "M1"),
            price(at(13), 0.3, "M2"),
            price(at(14), 0.9, "M2"),
            price(at(14), 0.0, "M3"),
        ],
    )
    # Swing 0.9 - 0.0; the market that never traded adds to the swing only.
    assert rows(reports.volatility_comparison(t, 0.9)) == [("high_volatility", 2, 0.45, 0.5, 0.35)]
    assert rows(reports.volatility_comparison(t, 0.95))[0][:2] == ("low_volatility", 2)


def fading(spark, closes, volumes=None):
    volumes = volumes or [1] * len(closes)
    return tables(
        spark,
        games=[game()],
        markets=[market()],
        prices=[
            price(at(13, i), c, volume=v) for i, (c, v) in enumerate(zip(closes, volumes))
        ],
    )


def test_fade_takes_first_and_last_traded_candles(spark):
    t = fading(spark, [0.0, 0.9, 0.7, 0.5, 0.3, 0.1], [50, 4, 4, 1, 1, 0])
    assert rows(reports.early_hype_fade(t, 0.3, window_size=2)) == [
        ("M", "H", 8, 10, 0.8, 0.8, 0.2, -0.6, 5)
    ]
    # Five traded candles are too few for two windows of three.
    assert rows(reports.early_hype_fade(t, 0.3, window_size=3)) == []


def test_fade_threshold_is_exact_and_inclusive(spark):
    assert len(rows(reports.early_hype_fade(fading(spark, [0.7, 0.4]), 0.3, 1))) == 1
    assert rows(reports.early_hype_fade(fading(spark, [0.7, 0.41]), 0.3, 1)) == []


def test_fade_without_volume_has_no_share(spark):
    t = fading(spark, [0.9, 0.1], [0, 0])
    assert rows(reports.early_hype_fade(t, 0.3, 1).select("early_volume_share")) == [(None,)]


def test_fade_is_the_same_however_the_candles_are_dealt(spark, monkeypatch):
    t = relations(spark, "/root/testdata/sf0.001")
    found = rows(reports.early_hype_fade(t, -1.0, 5))
    assert len(found) == 14
    for parts in (1, 3):
        monkeypatch.setattr(reports, "RANK_PARTS", parts)
        assert rows(reports.early_hype_fade(t, -1.0, 5)) == found


def test_fade_with_one_hot_market_and_long_windows(spark):
    """More candles than Spark would cut, whatever its threshold is."""
    n, size = 3000, 1200
    prices = spark.range(n).select(
        F.lit("M").alias("market_ticker"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("datetime_utc"),
        *[((n - F.col("id")) / n).alias(f"kalshi_{c}") for c in ("open", "high", "low", "close")],
        F.lit(1).alias("kalshi_volume"),
    )
    t = tables(spark, games=[game()], markets=[market()])
    expected = (n - (size - 1) / 2) / n, ((size + 1) / 2) / n
    for threshold in ("1000", "2"):
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
        (row,) = reports.early_hype_fade(replace(t, prices=prices), 0.1, size).collect()
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        assert (row["first_window_volume"], row["num_candles"]) == (size, n)
        assert (row["early_price"], row["late_price"]) == tuple(round(x, 3) for x in expected)


def test_history_is_newest_first_and_upper_cases_the_team(spark):
    t = fading(spark, [0.1, 0.2, 0.3])
    assert [r.kalshi_close for r in reports.team_market_history(t, "h", limit=2).collect()] == [
        0.3,
        0.2,
    ]
    shown = details.history_rows(t, "h").first()
    assert (shown.date, shown.time) == ("2025-09-07", "13:02:00")


def test_history_takes_whole_hours_and_candles_without_a_time_last(spark):
    t = tables(
        spark,
        games=[game()],
        markets=[market("M1"), market("M2"), market("M3", team="A")],
        prices=[
            *[price(at(13, k), 0.1, "M1") for k in range(3)],
            *[price(at(13, k), 0.2, "M2") for k in range(2)],
            price(at(9), 0.3, "M1"),
            price(None, 0.4, "M2"),
            *[price(at(20, k), 0.9, "M3") for k in range(9)],
        ],
    )

    def closes(limit):
        return [(r.market_ticker, r.kalshi_close) for r in reports.team_market_history(t, "H", limit).collect()]

    newest = [("M1", 0.1), ("M1", 0.1), ("M2", 0.2), ("M1", 0.1), ("M2", 0.2)]
    assert closes(2) == newest[:2] and closes(5) == newest
    assert closes(6) == newest + [("M1", 0.3)]
    assert closes(7) == closes(500) == newest + [("M1", 0.3), ("M2", 0.4)]
    assert closes(0) == []
    assert reports.team_market_history(t, "nobody").collect() == []


def test_coverage(spark):
    t = tables(
        spark,
        games=[game("G1"), game("G2"), game("G3"), game("G4")],
        markets=[market("M1", "G1"), market("M2", "G1"), market("M3", "G2"), market("M4", "X")],
        plays=[play(1, game_id="G1"), play(2, game_id="G1"), play(1, game_id="G3")],
    )
    assert rows(reports.game_coverage(t)) == [(4, 2, 2, 2, 1)]


def test_vegas_side_follows_the_target_team(spark):
    t = tables(
        spark,
        games=[game("G1"), game("G2"), game("G3")],
        markets=[market("M1", "G1", "H"), market("M2", "G2", "A"), market("M3", "G3", "X")],
        prices=[price(at(13), 0.7, m) for m in ("M1", "M2", "M3")],
        plays=[play(1, wp=0.6, game_id=g) for g in ("G1", "G2", "G3")],
    )
    # The third market's team plays in neither side, so its game drops out.
    assert rows(reports.vegas_vs_market(t)) == [(1, 2, 0.7, 0.5, 0.2)]
    assert [r.diff_class for r in details.vegas_week_class(t).collect()] == ["market_higher"]


def score_tables(spark):
    return tables(
        spark,
        games=[game()],
        markets=[market(), market("MA", team="A")],
        prices=[price(at(13, 0), 0.5), price(at(13, 1), 0.0), price(at(13, 0), 0.9, "MA")],
        plays=[
            # 13:00 Eastern in September is 17:00 UTC.
            play(1, score=(3, 0), wp=0.6, at=at(17, 0)),
            play(2, score=(3, 0), wp=0.8, at=at(17, 3)),
            play(3, score=(3, 0), wp=0.7, at=at(17, 3, 1)),
            play(4, score=(0, 0), wp=None, at=at(17, 0)),
            play(5, score=(0, 0), wp=0.5, at=None),
            play(6, qtr=5, score=(0, 0), wp=0.5, at=at(17, 0)),
            play(7, score=(0, 3), wp=0.5, at=at(16, 59)),
        ],
    )


def test_scores_take_the_latest_candle_zero_closes_included(spark):
    found = rows(reports.score_vs_market(score_tables(spark), min_obs=1))
    assert found == [(3, 2, 0.25, 0.7)]
    assert rows(reports.score_vs_market(score_tables(spark), min_obs=3)) == []


def test_score_summary(spark):
    scores = spark.createDataFrame(
        [(-3, 10, 0.4, 0.4), (0, 20, 0.5125, 0.5), (7, 5, 0.8, 0.8)],
        "score_diff int, num_observations long, avg_kalshi_home_price double, avg_vegas_wp double",
    )
    assert rows(details.score_summary(scores)) == [(3, 35, 51.3, -3, 7)]
    without_tie = details.score_summary(scores.filter("score_diff <> 0"))
    assert without_tie.first().tied_home_price_pct is None


def test_overlap_counts_games_within_ten_minutes(spark):
    t = tables(
        spark,
        games=[game("G1"), game("G2")],
        markets=[market("M1", "G1"), market("M2", "G2")],
        prices=[price(at(13), 0.5, "M1"), price(at(13), 0.5, "M2")],
        plays=[
            play(1, game_id="G1", at=at(16, 50)),
            play(2, game_id="G1", at=at(17, 10)),
            play(1, game_id="G2", at=at(17, 10, 1)),
            play(2, game_id="G2", at=at(16, 49, 59)),
            play(3, game_id="G2", at=None),
        ],
    )
    first = reports.timestamp_overlap(t).first()
    assert (first.plays_with_ts, first.plays_total, first.games_with_ts_overlap) == (4, 5, 1)


def test_play_filter(spark):
    plays = tables(
        spark,
        plays=[
            {**play(1, qtr=1), "down": 3, "ydstogo": 5, "play_type": "pass", "interception": 1},
            {**play(2, qtr=2), "down": 3, "ydstogo": 11, "play_type": "run", "interception": 0},
            {**play(3, qtr=2), "down": None, "ydstogo": 5, "play_type": "pass", "fumble": 1},
        ],
    ).plays

    def kept(**conditions):
        return sorted(r.play_id for r in reports.filter_plays(plays, **conditions).collect())

    assert kept() == [1, 2, 3]
    assert kept(qtr=2) == [2, 3]
    assert kept(down=3, ydstogo=(1, 10)) == [1]
    assert kept(play_type=["run", "kick"]) == [2]
    assert kept(interception=True) == [1]
    assert kept(interception=False) == [2]
    assert kept(fumble=True, qtr=[1, 2]) == [3]


def test_summary_cards(spark):
    t = season(spark, (0.7, 3, 0, 1), (0.6, 0, 3, 2), (0.3, 3, 0, 2), (0.9, 3, 0, 20))
    found = details.summary_cards(t, favorite_threshold=0.65, volatility_threshold=0.9).first()
    assert (found.favorite_games, found.favorite_win_rate_pct) == (2, 100.0)
    assert (found.underdog_games, found.underdog_win_rate_pct) == (1, 100.0)
    assert found.high_volatility_accuracy_pct is None
    # Week 1: 0.30, week 2: mean of 0.6 and 0.7; week 20 is out of season.
    assert found.avg_weekly_error == 0.475
    assert rows(details.summary_cards(t, 0, 0)) == rows(details.summary_cards(t))
    # 1 - 0.695 shows as 0.31 and 1 - 0.705 as 0.30: both are rounded, not cut.
    assert details.summary_cards(t, 0.695).first().underdog_games == 1
    assert details.summary_cards(t, 0.71).first().underdog_games == 0


def test_adversity_label(spark):
    t = season(spark, (0.7, 3, 0))
    found = details.adversity_label(t).first()
    assert (found.group_label, found.met_price) == ("No Major Adversity", True)


def test_calibration_gap(spark):
    t = season(spark, (0.95, 3, 0))
    found = details.calibration_gap(t).first()
    # A gap of exactly 0.05 is not well calibrated.
    assert (found.display_name, found.gap, found.well_calibrated) == ("Strong Favorite", 0.05, False)


@pytest.mark.parametrize(
    ("error", "label"),
    [(0.051, "overestimated"), (0.05, "neutral"), (-0.05, "neutral"), (-0.051, "underestimated")],
)
def test_bias_class(spark, error, label):
    t = season(spark, (round(0.5 + 2 * error, 3), 3, 0), (0.5, 0, 3))
    assert [r.bias_class for r in details.bias_class(t, 1).collect()] == [label]


def test_sort_any(spark):
    df = spark.createDataFrame(
        [("b", 2.0), ("A", -1.5), ("c", None), ("d", float("nan"))], "name string, x double"
    )
    assert [r.name for r in sort_any(df, "name").collect()] == ["A", "b", "c", "d"]
    down = sort_any(df, "name", ascending=False)
    assert [r.name for r in down.collect()] == ["d", "c", "b", "A"]
    # A missing number counts as 0.
    assert [r.name for r in sort_any(df, "x").collect()] == ["A", "c", "d", "b"]


def test_rounding_goes_away_from_zero_and_ignores_float_noise(spark):
    df = spark.createDataFrame([(0.0005,), (-0.0005,), (0.0015,), (1.0005,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 3)).collect()] == [
        0.001,
        -0.001,
        0.002,
        1.001,
    ]
    noisy = spark.createDataFrame([(0.1 + 0.2 - 0.2995,)], "x double")
    assert noisy.select(round_half_up(F.col("x"), 3)).first()[0] == 0.001
    assert noisy.select(percent(F.lit(0.0625))).first()[0] == 6.3


def test_side_by_side(spark):
    one = spark.createDataFrame([(1,)], "a int")
    two = spark.createDataFrame([(None, "x")], "b date, c string")
    assert rows(side_by_side(one, two)) == [(1, None, "x")]


def test_tolerance_and_zone_can_be_chosen(spark):
    t = score_tables(spark)
    wide = reports.score_vs_market(t, timedelta(minutes=5), min_obs=1, candle_zone="UTC")
    assert rows(wide) == []
