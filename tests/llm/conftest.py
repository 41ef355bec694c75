import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

# Fixture texts: nulls, empties, ties, repeated rows, near copies, a very long text, odd characters.
PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly watch from the old "
    "stone bridge and count every single leaf that drifts along the slow green river toward the sea"
)
DOCS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE + " today", "en", "b"),
    (4, None, "en", "b"),
    (5, "", "fr", "b"),
    (6, "le renard brun saute par-dessus le chien paresseux et la rivière", "fr", "b"),
    (7, "one", None, None),
    (8, "one", None, None),
    (None, PROSE.upper(), "en", "c"),
    (None, None, None, None),
    (9, "Ünï çødé \U0001f600 text \x00 with odd   spaces", None, "c"),
    (10, " ".join(f"word{i % 977} {PROSE[i % 50 : i % 50 + 20]}" for i in range(4000)), "en", "d"),
    (11, " \t\n ", "de", "d"),
    (12, "der schnelle braune fuchs springt über den faulen hund und die brücke", "de", "d"),
    (2**60 + 1, PROSE.replace("wizards", "lizards"), "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with more columns whose names clash with the operators' own."""
    names = "_id _key _hit _block _local _final row key word n token"
    rows = [(*d, "x", 7, "y", 3, *range(len(names.split()))) for d in DOCS]
    more = "".join(f", {name} int" for name in names.split())
    return spark.createDataFrame(
        rows, SCHEMA + ", sketch string, shard int, cid string, _bucket int" + more
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
