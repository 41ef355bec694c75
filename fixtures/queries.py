"""Every operator as a query on the relations derived from the test tables.

Thresholds differ from the defaults only where FIXTURES.md says so, because the
test data is sparser in time than real candles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import raw
from fixtures.relations import relations
from fourthtick import Tables
from fourthtick.operators import combine, distinct, quality
from fourthtick.plans import details, ingest, landing, reports, routes, summaries, views
from fourthtick.sources import storage

TEAM = "T01"
SIX_HOURS = timedelta(hours=6)


def _thirds(t: Tables) -> list[Tables]:
    """The tables' candles and plays in three parts, by minute and by play."""
    return [
        replace(
            t,
            plays=t.plays.filter(f"play_id % 3 = {k}"),
            prices=t.prices.filter(f"coalesce(minute(datetime_utc), 0) % 3 = {k}"),
        )
        for k in range(3)
    ]


def _with_increment_states(t: Tables) -> Tables:
    """Facts out of the states of three increments, one of them stored twice, compacted half way."""
    folder = f"{storage.shared_folder(t.spark)}/states-{uuid.uuid4().hex}"
    first, second, third = _thirds(t)
    summaries.add_states(first, folder)
    summaries.add_states(second, folder, "second")
    summaries.compact_states(t.spark, folder, f"{folder}-compact")
    for _ in range(2):
        summaries.add_states(third, f"{folder}-compact", "third")
    return summaries.with_states(t, f"{folder}-compact")


def _overlap_by_day(t: Tables) -> DataFrame:
    """Sets of the games of two halves of the plays, stored apart; numbers of the second added to the first's."""
    folder = f"{storage.shared_folder(t.spark)}/overlap-{uuid.uuid4().hex}"
    early = t.games.filter("week <= 10")
    numbers = distinct.numbered(early, "game_id")
    for k, games in enumerate((early, t.games)):
        numbers = distinct.numbered(games, "game_id", numbers)
        plays = t.plays.join(games.select("game_id"), "game_id", "left_semi")
        reports.overlap_sets(replace(t, plays=plays), numbers).write.parquet(f"{folder}/part={k}")
    return reports.overlap_by_day(t.spark.read.parquet(folder))


def _route(call: str, **args) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        routes.publish_functions(t)
        return t.spark.sql(f"SELECT * FROM {call}", args=args)

    return run


def _on_tables(run: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(relations(spark, sf_dir))


def _scores(t: Tables) -> DataFrame:
    return reports.score_vs_market(t, tolerance=SIX_HOURS, min_obs=3)


def _filtered_scores(t: Tables) -> DataFrame:
    """Score report over early-down plays only."""
    chosen = reports.filter_plays(
        t.plays, qtr=[1, 2, 3], down=[1, 2], ydstogo=(2, 9), interception=False, fumble=False
    )
    return reports.score_vs_market(
        Tables(t.teams, t.games, chosen, t.markets, t.prices), tolerance=SIX_HOURS, min_obs=1
    )


def _candidates(t: Tables) -> DataFrame:
    return ingest.event_ticker_candidates(t.games, raw.OVERRIDES, raw.CODES, raw.PREFIX)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _candidates(relations(spark, sf_dir))
    return ingest.resolve_event_ticker(candidates, raw.markets(spark, sf_dir))


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    landed = raw.markets(spark, sf_dir)
    resolved = ingest.resolve_event_ticker(_candidates(t), landed)
    return ingest.select_winner_market(landed, resolved, t.games, raw.CODES)


def _new_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.market_target_team(_winners(spark, sf_dir), raw.CODES)


def _candle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = ingest.flatten_candles(raw.candles(spark, sf_dir))
    return ingest.candle_window(candles, raw.closings(spark, sf_dir))


def _known(t: Tables) -> DataFrame:
    """Half of the markets, as if ingested by an earlier run."""
    return t.markets.filter(F.col("target_team") < "T12")


def _appended_prices(t: Tables) -> DataFrame:
    """Candles of the second half arrive together with a repetition of the first half."""
    known = _known(t)
    stored = t.prices.join(known.select("market_ticker"), "market_ticker", "left_semi")
    added = ingest.unknown_markets(known, t.markets)
    return ingest.append_prices(stored, added, t.prices)


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = relations(spark, sf_dir).games
    return ingest.failed_games_report(
        games, raw.markets(spark, sf_dir), raw.OVERRIDES, raw.CODES, raw.PREFIX
    )


INGEST = {
    "team_names": raw.TEAM_NAMES,
    "overrides": raw.OVERRIDES,
    "market_codes": raw.CODES,
    "prefix": raw.PREFIX,
}


def _ingest(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame]:
    """All five tables out of the raw shapes, every page landed twice."""
    pages = raw.candles(spark, sf_dir, raw.WINNER_TICKER)
    return ingest.build_tables(
        raw.play_by_play(spark, sf_dir), raw.markets(spark, sf_dir), pages.union(pages), **INGEST
    )


def _whole_ingest(spark: SparkSession, sf_dir: str) -> Tables:
    return _ingest(spark, sf_dir)[0]


def _two_ingests(spark: SparkSession, sf_dir: str) -> Tables:
    """The games of even users first, then an increment with the play-by-play of the others."""
    plays, markets = raw.play_by_play(spark, sf_dir), raw.markets(spark, sf_dir)
    pages = raw.candles(spark, sf_dir, raw.WINNER_TICKER)
    even = F.substring("game_id", 2, 20).cast("int") % 2 == 0
    folder = f"{storage.shared_folder(spark)}/increments-{uuid.uuid4().hex}"
    earlier, _ = ingest.build_tables(plays.filter(even), markets, pages, **INGEST)
    storage.save_tables(earlier, folder)
    stored = storage.open_tables(spark, folder)
    delta, _ = ingest.build_increment(plays.filter(~even), markets, pages, stored, **INGEST)
    # A table is read while its increment is made, so the increment is stored first.
    storage.save_tables(delta, f"{folder}/delta")
    storage.save_tables(storage.open_tables(spark, f"{folder}/delta"), folder, mode="append")
    return storage.open_tables(spark, folder)


def _taken_in(spark: SparkSession, sf_dir: str) -> Tables:
    """What two landings leave in the store, each taken in by a stream; markets land with the first."""
    base = f"{storage.shared_folder(spark)}/taken-{uuid.uuid4().hex}"
    landed, store = f"{base}/landed", f"{base}/store"
    plays, markets = raw.play_by_play(spark, sf_dir), raw.markets(spark, sf_dir)
    pages = raw.candles(spark, sf_dir, raw.WINNER_TICKER)
    even = F.substring("game_id", 2, 20).cast("int") % 2 == 0
    plays.filter(even).write.parquet(f"{landed}/play_by_play")
    markets.write.json(f"{landed}/markets")
    pages.write.json(f"{landed}/candles")
    landing.take_in(spark, landed, store, **INGEST)
    plays.filter(~even).write.mode("append").parquet(f"{landed}/play_by_play")
    landing.take_in(spark, landed, store, **INGEST)
    return storage.open_tables(spark, store)


def _stored_twice(spark: SparkSession, sf_dir: str) -> Tables:
    """Candles and plays stored as increments, the last of them twice."""
    folder = f"{storage.shared_folder(spark)}/repeated-{uuid.uuid4().hex}"
    first, second, third = _thirds(relations(spark, sf_dir))
    storage.save_tables(first, folder)
    for name, part in (("second", second), ("third", third), ("third", third)):
        rest = {k: getattr(part, k).limit(0) for k in ("teams", "games", "markets")}
        storage.save_increment(replace(part, **rest), folder, name)
    return storage.open_tables(spark, folder)


def _damaged(t: Tables) -> Tables:
    """Keys three times and NULL, a team without a name, and an orphan of each reference."""
    plays, prices = t.plays.filter("play_id % 50 = 3"), t.prices.filter("kalshi_volume = 7")
    return Tables(
        teams=t.teams.filter("team_abbr <> 'T05'")
        .withColumn("team_name", F.expr("if(team_abbr = 'T02', NULL, team_name)"))
        .unionByName(t.teams.filter("team_abbr = 'T03'")),
        games=t.games.filter("week <> 9").withColumn(
            "game_id", F.expr("if(week = 8, NULL, game_id)")
        ),
        plays=t.plays.unionByName(plays).unionByName(plays),
        markets=t.markets.filter("market_ticker NOT LIKE '%3'"),
        prices=t.prices.unionByName(prices),
    )


def _landed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables out of CSV files whose play texts hold quotes and line breaks."""
    t = relations(spark, sf_dir)
    text = F.concat(F.lit('said "go, '), F.col("description"), F.lit('"\n'), F.col("play_type"))
    t = replace(t, plays=t.plays.withColumn("description", text))
    folder = f"{storage.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for name, rows in t.named().items():
        storage.write_csv_table(rows, folder, name)
    return storage.load_tables(spark, folder)


def _bad_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a games file whose week is no number."""
    games = relations(spark, sf_dir).games
    week = F.expr("if(week = 3, 'third', cast(week as string))")
    folder = f"{storage.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    storage.write_csv_table(games.withColumn("week", week), folder, "games")
    return storage.rejected_csv_rows(spark, folder, "games")


def _stored(spark: SparkSession, sf_dir: str) -> Tables:
    folder = f"{storage.shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    storage.save_tables(relations(spark, sf_dir), folder)
    return storage.open_tables(spark, folder)


def _kept_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write that is only wanted where nothing is there."""
    teams = relations(spark, sf_dir).teams
    folder = f"{storage.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    storage.write_csv_table(teams, folder, "teams")
    storage.write_csv_table(teams.limit(1), folder, "teams", only_if_absent=True)
    return storage.read_csv_table(spark, folder, "teams")


def _results_of_a_quarter(t: Tables) -> DataFrame:
    """Winners by the plays of one quarter, on tables that hold facts of all plays."""
    first = reports.filter_plays(t.plays, qtr=1)
    return views.game_results(replace(views.with_facts(t), plays=first))


def _landed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unique_candles(ingest.flatten_candles(raw.candle_files(spark, sf_dir)))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected_payloads(
        raw.markets(spark, sf_dir), raw.candle_files(spark, sf_dir)
    )


def _swings_of_favorites(t: Tables) -> DataFrame:
    """The published views, joined in SQL."""
    views.publish_views(t)
    return t.spark.sql(
        """SELECT f.game_id, f.favorite_team, f.favorite_prob, v.price_swing, p.market_ticker
           FROM favorite_summary f
           JOIN game_volatility v ON v.game_id = f.game_id
           JOIN pregame_prices p ON p.game_id = f.game_id AND p.rn = 1
           WHERE f.favorite_prob >= :floor AND f.favorite_won = 1""",
        args={"floor": 0.5},
    )


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as CSV and loaded again, seen through sums over every table."""
    tables = relations(spark, sf_dir)
    folder = f"{storage.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for name, rows in tables.named().items():
        storage.write_csv_table(rows, folder, name)
    t = storage.load_tables(spark, folder)
    return combine.side_by_side(
        t.teams.agg(F.count("team_name").alias("teams")),
        t.games.agg(
            F.count("away_team").alias("games"), F.max("game_date").alias("last_game_date")
        ),
        t.plays.agg(
            F.count("description").alias("plays"),
            F.count("down").alias("plays_with_down"),
            F.sum("play_id").alias("play_id_sum"),
            F.max("timestamp_utc").alias("last_play_at"),
            F.sum(F.length("description")).alias("description_chars"),
        ),
        t.markets.agg(F.count("market_title").alias("markets")),
        t.prices.agg(
            F.count("*").alias("candles"),
            F.sum((F.col("kalshi_close") * 100).cast("decimal(12,0)").cast("long")).alias("cents"),
            F.min("datetime_utc").alias("first_candle_at"),
        ),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # Views
    "pregame_prices": _on_tables(views.pregame_prices),
    "game_results": _on_tables(views.game_results),
    "game_volatility": _on_tables(views.game_volatility),
    "favorite_summary": _on_tables(views.favorite_summary),
    "first_play_wp": _on_tables(views.first_play_wp),
    "published_views": _on_tables(_swings_of_favorites),
    # Reports
    "market_bias": _on_tables(reports.market_bias),
    "market_bias_from_facts": _on_tables(lambda t: reports.market_bias(views.with_facts(t))),
    "market_bias_from_increments": _on_tables(
        lambda t: reports.market_bias(_with_increment_states(t))
    ),
    "results_from_increments": _on_tables(lambda t: views.game_results(_with_increment_states(t))),
    "market_swings": _on_tables(reports.market_swings),
    "adversity_performance": _on_tables(reports.adversity_performance),
    "accuracy_by_week": _on_tables(reports.accuracy_by_week),
    "volatility_comparison": _on_tables(lambda t: reports.volatility_comparison(t, 0.97)),
    "underdog_win_rate": _on_tables(reports.underdog_win_rate),
    "favorite_win_rate": _on_tables(reports.favorite_win_rate),
    "favorite_calibration": _on_tables(reports.favorite_calibration),
    "team_market_history": _on_tables(lambda t: reports.team_market_history(t, TEAM)),
    "team_market_history_50": _on_tables(lambda t: reports.team_market_history(t, TEAM, 50)),
    "early_hype_fade": _on_tables(lambda t: reports.early_hype_fade(t, 0.1)),
    "game_coverage": _on_tables(reports.game_coverage),
    "vegas_vs_market": _on_tables(reports.vegas_vs_market),
    "score_vs_market": _on_tables(_scores),
    "timestamp_overlap": _on_tables(reports.timestamp_overlap),
    "overlap_by_day": _on_tables(_overlap_by_day),
    # Reports as table functions
    "sql_market_bias": _on_tables(_route("market_bias(:least)", least=5)),
    "sql_market_swings": _on_tables(_route("market_swings()")),
    "sql_underdog_win_rate": _on_tables(_route("underdog_win_rate(max_prob => :most)", most=0.4)),
    "sql_favorite_win_rate": _on_tables(_route("favorite_win_rate()")),
    "sql_early_hype_fade": _on_tables(_route("early_hype_fade(:drop, 5)", drop=0.1)),
    # Ingest
    "build_games": lambda spark, d: ingest.build_games(raw.play_by_play(spark, d)),
    "build_plays": lambda spark, d: ingest.build_plays(raw.play_by_play(spark, d)),
    "build_teams": _on_tables(lambda t: ingest.build_teams(t.games, raw.TEAM_NAMES)),
    "event_ticker_candidates": _on_tables(_candidates),
    "resolve_event_ticker": _resolved,
    "select_winner_market": _winners,
    "market_target_team": _new_markets,
    "flatten_candles": lambda spark, d: ingest.flatten_candles(raw.candles(spark, d)),
    "candle_window": _candle_window,
    "incremental_new_games": _on_tables(
        lambda t: ingest.incremental_new_games(t.games, t.markets, force=["G1", "G2"])
    ),
    "append_dedup_markets": _on_tables(lambda t: ingest.append_markets(_known(t), t.markets)),
    "append_dedup_prices": _on_tables(_appended_prices),
    "failed_games_report": _failed,
    "build_tables": lambda spark, d: _whole_ingest(spark, d).prices,
    "build_tables_games": lambda spark, d: _whole_ingest(spark, d).games,
    "build_tables_plays": lambda spark, d: _whole_ingest(spark, d).plays,
    "build_tables_teams": lambda spark, d: _whole_ingest(spark, d).teams,
    "build_tables_markets": lambda spark, d: _whole_ingest(spark, d).markets,
    "build_tables_failed": lambda spark, d: _ingest(spark, d)[1],
    "build_tables_increment": lambda spark, d: _two_ingests(spark, d).prices,
    "build_tables_increment_games": lambda spark, d: _two_ingests(spark, d).games,
    "build_tables_increment_plays": lambda spark, d: _two_ingests(spark, d).plays,
    "build_tables_increment_teams": lambda spark, d: _two_ingests(spark, d).teams,
    "build_tables_increment_markets": lambda spark, d: _two_ingests(spark, d).markets.select(
        "market_ticker", "target_team"
    ),
    "taken_in_prices": lambda spark, d: _taken_in(spark, d).prices,
    "taken_in_games": lambda spark, d: _taken_in(spark, d).games,
    "taken_in_plays": lambda spark, d: _taken_in(spark, d).plays,
    "landed_candles": _landed_candles,
    "rejected_payloads": _rejected,
    "play_by_play_files": lambda spark, d: ingest.build_plays(raw.play_files(spark, d)),
    "load_tables": _csv_round_trip,
    "load_tables_teams": lambda spark, d: _landed_tables(spark, d).teams,
    "load_tables_games": lambda spark, d: _landed_tables(spark, d).games,
    "load_tables_plays": lambda spark, d: _landed_tables(spark, d).plays,
    "load_tables_markets": lambda spark, d: _landed_tables(spark, d).markets,
    "load_tables_prices": lambda spark, d: _landed_tables(spark, d).prices,
    "rejected_csv_rows": _bad_csv_rows,
    "stored_plays": lambda spark, d: _stored(spark, d).plays,
    "stored_prices": lambda spark, d: _stored(spark, d).prices,
    "stored_twice_plays": lambda spark, d: _stored_twice(spark, d).plays,
    "stored_twice_prices": lambda spark, d: _stored_twice(spark, d).prices,
    "csv_only_if_absent": _kept_csv,
    "check_keys": _on_tables(quality.check_keys),
    "check_keys_damaged": _on_tables(lambda t: quality.check_keys(_damaged(t))),
    "check_references_damaged": _on_tables(lambda t: quality.check_references(_damaged(t))),
    "key_violations": _on_tables(lambda t: quality.key_violations(t.plays, ["game_id", "down"])),
    "check_references": _on_tables(quality.check_references),
    "orphans": _on_tables(lambda t: quality.orphans(t.plays, "game_id", t.markets, "game_id")),
    "filter_plays": _on_tables(_filtered_scores),
    "filter_plays_with_facts": _on_tables(_results_of_a_quarter),
    # Details
    "summary_cards": _on_tables(lambda t: details.summary_cards(t, volatility_threshold=0.97)),
    "coverage_pct": _on_tables(details.coverage_pct),
    "calibration_gap": _on_tables(details.calibration_gap),
    "swing_severity": _on_tables(details.swing_severity),
    "bias_class": _on_tables(details.bias_class),
    "bias_top20": _on_tables(lambda t: details.bias_top20(t, min_games=2)),
    "fade_severity": _on_tables(lambda t: details.fade_severity(t, 0.1)),
    "fade_top20": _on_tables(lambda t: details.fade_top20(t, 0.1)),
    "vegas_season_summary": _on_tables(details.vegas_season_summary),
    "vegas_week_class": _on_tables(details.vegas_week_class),
    "score_summary": _on_tables(lambda t: details.score_summary(_scores(t))),
    "history_rows": _on_tables(lambda t: details.history_rows(t, TEAM)),
    "adversity_label": _on_tables(details.adversity_label),
    "sort_any": _on_tables(
        lambda t: combine.sort_any(reports.early_hype_fade(t, 0.1), "target_team", ascending=False)
    ),
    "week_label": _on_tables(details.accuracy_with_week_label),
}
