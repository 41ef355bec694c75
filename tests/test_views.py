from build import at, game, market, play, price, rows, tables
from fixtures.relations import relations
from fourthtick.plans import views


def winner(spark, *plays):
    t = tables(spark, games=[game()], plays=plays)
    return rows(views.game_results(t))


def test_tie_has_no_winner(spark):
    assert winner(spark, play(1, score=(7, 7))) == [("G", None)]


def test_last_play_is_latest_quarter_then_least_time_then_highest_id(spark):
    assert winner(
        spark,
        play(9, qtr=4, left=0.0, score=(0, 3)),
        play(2, qtr=5, left=30.0, score=(0, 6)),
        play(3, qtr=5, left=10.0, score=(9, 6)),
        play(4, qtr=5, left=10.0, score=(9, 12)),
    ) == [("G", "A")]


def test_null_quarter_counts_as_last(spark):
    assert winner(
        spark, play(1, qtr=5, left=0.0, score=(3, 0)), play(2, qtr=None, score=(0, 3))
    ) == [("G", "A")]


def test_null_seconds_count_as_early_at_the_end_and_as_early_at_the_start(spark):
    t = tables(
        spark,
        games=[game()],
        plays=[
            play(1, qtr=1, left=None, score=(0, 3), wp=0.9),
            play(2, qtr=1, left=900.0, score=(3, 0), wp=0.1),
        ],
    )
    # Last play: time left ascending, NULL last. First play: descending, NULL first.
    assert rows(views.game_results(t)) == [("G", "H")]
    assert rows(views.first_play_wp(t)) == [("G", 0.9)]


def test_first_play_skips_missing_probability_and_breaks_ties_by_id(spark):
    t = tables(
        spark,
        games=[game()],
        plays=[
            play(1, left=900.0),
            play(3, left=850.0, wp=0.3),
            play(2, left=850.0, wp=0.2),
            play(4, qtr=2, left=900.0, wp=0.4),
        ],
    )
    assert rows(views.first_play_wp(t)) == [("G", 0.2)]
    assert rows(views.play_facts(t).select("home_vegas_wp")) == [(0.2,)]


def test_plays_of_unknown_games_have_no_result(spark):
    t = tables(spark, games=[game("G1")], plays=[play(1, game_id="G2")])
    assert rows(views.game_results(t)) == []


def test_pregame_price_skips_zero_and_volatility_does_not(spark):
    t = tables(
        spark,
        games=[game()],
        markets=[market()],
        prices=[price(at(13), 0.0), price(at(14), 0.6), price(at(15), 0.9)],
    )
    assert sorted(rows(views.pregame_prices(t).select("kalshi_close", "rn"))) == [
        (0.6, 1),
        (0.9, 2),
    ]
    assert rows(views.first_prices(t).select("kalshi_close")) == [(0.6,)]
    assert rows(views.game_volatility(t)) == [("G", 0.9)]


def test_ranks_run_on_over_time_slices(spark):
    minutes = [(13, 0), (13, 59), (14, 0), (14, 1), (18, 30), (23, 59)]
    t = tables(
        spark,
        games=[game()],
        markets=[market()],
        prices=[price(at(h, m), (i + 1) / 10) for i, (h, m) in enumerate(minutes)],
    )
    ranked = rows(views.pregame_prices(t).select("kalshi_close", "rn"))
    assert sorted(ranked) == [((i + 1) / 10, i + 1) for i in range(6)]


def test_tied_game_counts_as_lost_for_the_favorite(spark):
    t = tables(
        spark,
        games=[game()],
        plays=[play(1, score=(7, 7))],
        markets=[market()],
        prices=[price(at(13), 0.7)],
    )
    assert rows(views.favorite_summary(t)) == [("G", "H", 0.7, 0.0)]


def test_reports_read_the_same_from_written_facts(spark):
    t = tables(
        spark,
        games=[game()],
        plays=[play(1, score=(7, 0), wp=0.6)],
        markets=[market(), market("M2", team="A")],
        prices=[price(at(13), 0.7), price(at(14), 0.0), price(at(13), 0.0, "M2")],
    )
    stored = views.with_facts(t)
    for view in [
        views.game_results,
        views.game_volatility,
        views.favorite_summary,
        views.first_play_wp,
    ]:
        assert rows(view(stored)) == rows(view(t))


def test_published_views_answer_sql(spark):
    t = tables(
        spark, games=[game()], markets=[market()], prices=[price(at(13), 0.7), price(at(14), 0.8)]
    )
    views.publish_views(t)
    found = spark.sql("SELECT kalshi_close FROM pregame_prices WHERE rn = 1")
    assert rows(found) == [(0.7,)]
    assert spark.table("kalshi_prices").count() == 2


def test_facts_do_not_outlive_their_source(spark):
    from dataclasses import replace

    t = tables(
        spark,
        games=[game()],
        plays=[play(1, qtr=1, score=(7, 0), wp=0.5), play(2, qtr=4, score=(7, 10), wp=0.5)],
    )
    stored = views.with_facts(t)
    assert rows(views.game_results(stored)) == [("G", "A")]
    filtered = replace(stored, plays=t.plays.filter("qtr = 1"))
    assert filtered.play_facts is None and stored.play_facts is not None
    assert rows(views.game_results(filtered)) == [("G", "H")]


def test_first_rank_of_the_published_view_is_cut_before_the_shuffle(spark):
    t = relations(spark, "/root/testdata/sf0.001")
    views.publish_views(t, prefix="ours_")
    first = spark.sql("SELECT * FROM ours_pregame_prices WHERE rn = 1")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
