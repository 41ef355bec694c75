"""DuckDB statements that state, independently of the Spark code, what each query returns."""

from oracle import details, ingest, reports

ORACLES = {**reports.ORACLES, **ingest.ORACLES, **details.ORACLES}
