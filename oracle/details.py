from oracle import reports as r
from oracle.relations import query, rounded


def pct(share: str) -> str:
    return f"round(CAST({share} AS DECIMAL(18, 10)) * 100, 1)::DOUBLE"


def three_way(column: str, band: float, over: str, under: str, neutral: str) -> str:
    return f"CASE WHEN {column} > {band} THEN '{over}' WHEN {column} < -{band} THEN '{under}' ELSE '{neutral}' END"


ORACLES = {
    "summary_cards": query(
        f"""SELECT
    {pct('f.rate')} AS favorite_win_rate_pct, f.n AS favorite_games,
    {pct('u.rate')} AS underdog_win_rate_pct, u.n AS underdog_games,
    {pct('1 - v.avg_error')} AS high_volatility_accuracy_pct,
    w.error AS avg_weekly_error
FROM (SELECT count(*) AS n, coalesce({r.avg('won', 3)}, 0) AS rate FROM played WHERE price >= 0.5) f,
     (SELECT count(*) AS n, coalesce({r.avg('won', 3)}, 0) AS rate FROM played WHERE price <= 0.5) u,
     (SELECT max(avg_error) AS avg_error FROM volatility WHERE volatility_group = 'high_volatility') v,
     (SELECT {r.avg('error', 3)} AS error FROM weeks) w""",
        r.VOLATILITY,
        r.WEEKS,
    ),
    "coverage_pct": query(
        f"SELECT *, {pct('games_with_kalshi / nullif(total_games, 0)')} AS coverage_pct FROM coverage",
        r.COVERAGE,
    ),
    "calibration_gap": query(
        """SELECT *, abs(gap) < 0.05 AS well_calibrated FROM (
    SELECT *, upper(favorite_strength[1]) || split_part(favorite_strength, '_', 1)[2:] || ' Favorite' AS display_name,
           """
        + rounded("actual_win_rate - avg_predicted", 3)
        + " AS gap FROM calibration)",
        r.CALIBRATION,
    ),
    "swing_severity": query(
        "SELECT *, CASE WHEN price_swing > 0.2 THEN 'high' WHEN price_swing > 0.1 THEN 'medium'"
        " ELSE 'low' END AS severity FROM top_swings",
        r.SWINGS,
    ),
    "bias_class": query(
        "SELECT *, "
        + three_way("avg_signed_error", 0.05, "overestimated", "underestimated", "neutral")
        + " AS bias_class FROM bias",
        r.BIAS,
    ),
    "bias_top20": query(
        "FROM bias ORDER BY avg_signed_error DESC, target_team LIMIT 20", r.bias(2)
    ),
    "fade_severity": query(
        "SELECT *, abs(price_change) AS price_drop, CASE WHEN abs(price_change) > 0.3 THEN 'high'"
        " WHEN abs(price_change) > 0.15 THEN 'medium' ELSE 'low' END AS severity FROM fades",
        r.FADES,
    ),
    "fade_top20": query(
        "SELECT market_ticker, target_team AS label, abs(price_change) AS price_drop,"
        " early_price, late_price FROM fades"
        " ORDER BY price_change, early_price DESC, market_ticker LIMIT 20",
        r.FADES,
    ),
    "vegas_season_summary": query(
        f"""SELECT count(*) AS weeks_analyzed, {pct('avg(avg_kalshi_prob)')} AS avg_kalshi_prob_pct,
    {pct('avg(avg_vegas_wp)')} AS avg_vegas_wp_pct,
    coalesce({pct('avg(avg_diff)')}, 0) AS avg_diff_pct FROM vegas""",
        r.VEGAS,
    ),
    "vegas_week_class": query(
        "SELECT *, 'W' || week AS week_label, "
        + three_way("avg_diff", 0.03, "market_higher", "market_lower", "close")
        + " AS diff_class FROM vegas",
        r.VEGAS,
    ),
    "score_summary": query(
        f"""SELECT count(*) AS score_bands, coalesce(sum(num_observations), 0)::BIGINT AS total_observations,
    {pct('max(avg_kalshi_home_price) FILTER (score_diff = 0)')} AS tied_home_price_pct,
    min(score_diff) AS min_diff, max(score_diff) AS max_diff FROM scores""",
        r.SCORES,
    ),
    "history_rows": query(
        """SELECT strftime(datetime_utc, '%Y-%m-%d') AS date, strftime(datetime_utc, '%H:%M:%S') AS time,
    market_ticker AS ticker, kalshi_open AS open, kalshi_high AS high, kalshi_low AS low,
    kalshi_close AS close, kalshi_volume AS volume FROM history""",
        r.HISTORY.format(limit=100),
    ),
    "adversity_label": query(
        """SELECT *, if(experienced_major_adversity = 1, 'Faced Adversity', 'No Major Adversity') AS group_label,
    favorite_win_rate >= avg_pregame_prob AS met_price FROM adversity""",
        r.ADVERSITY,
    ),
    "sort_any": query("FROM fades ORDER BY lower(target_team) DESC", r.FADES),
    "week_label": query("SELECT *, 'W' || week AS week_label FROM weeks", r.WEEKS),
}
