from pyspark.sql import Column
from pyspark.sql import functions as F

# Averages of cent prices often sit on an exact half. Going through a decimal
# drops the last bits of float noise, so that halves round away from zero no
# matter in which order partitions were summed.
EXACT = "decimal(18,10)"


def exact(value: Column) -> Column:
    """The value as a decimal, free of float noise."""
    return value.cast(EXACT)


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(exact(value), digits).cast("double")


def percent(share: Column, digits: int = 1) -> Column:
    """A share in 0..1 as a rounded percentage."""
    return F.round(exact(share) * 100, digits).cast("double")
