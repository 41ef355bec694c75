from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_codes(code: Column, names: Mapping[str, str]) -> Column:
    """``names[code]``, or the code itself when it has no entry."""
    if not names:
        return code
    table = F.create_map(*[F.lit(part) for pair in sorted(names.items()) for part in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def title_from_snake(name: Column) -> Column:
    """``strong_favorite`` -> ``Strong Favorite``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def classify(value: Column, above: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first threshold the value exceeds (strictly)."""
    label = F.lit(otherwise)
    for threshold, name in reversed(above):
        label = F.when(value > threshold, name).otherwise(label)
    return label


def signed_class(value: Column, band: float, over: str, under: str, neutral: str) -> Column:
    """``over`` beyond +band, ``under`` beyond -band, else ``neutral``."""
    return F.when(value > band, over).when(value < -band, under).otherwise(neutral)
