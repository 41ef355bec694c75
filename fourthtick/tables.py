from __future__ import annotations

from dataclasses import dataclass, fields
from typing import NamedTuple

from pyspark.sql import DataFrame


class Facts(NamedTuple):
    """A stored summary and the frame it was made of."""

    rows: DataFrame
    source: DataFrame


@dataclass(frozen=True)
class Tables:
    """The five relations, plus optional precomputed fact summaries.

    The summaries are filled by ``plans.views.with_facts``; reports then read one
    row per market and per game instead of scanning candles and plays again. A
    summary counts only while its source is still the table: replacing plays or
    prices makes the reports read the new rows.
    """

    teams: DataFrame
    games: DataFrame
    plays: DataFrame
    markets: DataFrame
    prices: DataFrame
    facts_of_prices: Facts | None = None
    facts_of_plays: Facts | None = None

    @property
    def market_facts(self) -> DataFrame | None:
        facts = self.facts_of_prices
        return facts.rows if facts and facts.source is self.prices else None

    @property
    def play_facts(self) -> DataFrame | None:
        facts = self.facts_of_plays
        return facts.rows if facts and facts.source is self.plays else None

    @property
    def spark(self):
        return self.games.sparkSession

    def named(self) -> dict[str, DataFrame]:
        """Stored table name -> DataFrame, for the five relations."""
        return {STORED_NAMES.get(f.name, f.name): getattr(self, f.name) for f in fields(self)[:5]}


# Fixed names of the stored tables where they differ from the attribute.
STORED_NAMES = {"markets": "kalshi_markets", "prices": "kalshi_prices"}
