"""Small hand-made tables. Columns that are not given are NULL."""

from datetime import datetime

from fourthtick import Tables, schemas


def frame(spark, table, rows):
    schema = schemas.TABLES[table]
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def tables(spark, games=(), plays=(), markets=(), prices=(), teams=()):
    return Tables(
        teams=frame(spark, "teams", teams),
        games=frame(spark, "games", games),
        plays=frame(spark, "plays", plays),
        markets=frame(spark, "kalshi_markets", markets),
        prices=frame(spark, "kalshi_prices", prices),
    )


def game(game_id="G", home="H", away="A", week=1, **more):
    return dict(game_id=game_id, home_team=home, away_team=away, week=week, **more)


def market(ticker="M", game_id="G", team="H"):
    return dict(market_ticker=ticker, game_id=game_id, target_team=team)


def price(at, close, ticker="M", volume=1):
    return dict(
        market_ticker=ticker, datetime_utc=at, kalshi_close=close, kalshi_volume=volume
    )


def play(play_id, qtr=1, left=900.0, score=(0, 0), wp=None, at=None, game_id="G"):
    return dict(
        game_id=game_id,
        play_id=play_id,
        qtr=qtr,
        quarter_seconds_remaining=left,
        total_home_score=score[0],
        total_away_score=score[1],
        vegas_wp=wp,
        timestamp_utc=at,
    )


def at(hour, minute=0, second=0, day=7, month=9):
    return datetime(2025, month, day, hour, minute, second)


def rows(df):
    return [tuple(r) for r in df.collect()]
