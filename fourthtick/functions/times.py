"""Time helpers on zone-less timestamps. None depends on the session time zone."""

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def utc_to_wall(utc: Column, zone: str = EASTERN) -> Column:
    """UTC clock to the wall clock of a zone, following its daylight saving rules."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def wall_to_utc(wall: Column, zone: str = EASTERN) -> Column:
    """Wall clock of a zone to UTC.

    The hour that occurs twice in autumn is read as standard time. Java reads it
    as summer time; converting one hour later and stepping back gives the other
    reading, and the later of the two instants is the standard-time one.
    """
    hour = F.lit(timedelta(hours=1))

    def convert(t: Column) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), t)

    return F.greatest(convert(wall), convert(wall + hour) - hour)


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970-01-01 on the timestamp's own clock."""
    return (t - _epoch()).cast("interval second").cast("long")


def from_epoch_seconds(seconds: Column) -> Column:
    """Zone-less UTC timestamp of an epoch second."""
    return _epoch() + F.make_dt_interval(secs=seconds)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def time_slice(t: Column, width_seconds: int) -> Column:
    """Number of the fixed-width slice of time that holds ``t``."""
    return F.floor(epoch_seconds(t) / F.lit(width_seconds))
