"""Game plays and prediction-market prices, analysed on Spark."""

from fourthtick.tables import Tables

__all__ = ["Tables"]
