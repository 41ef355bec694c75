"""The five relations and the raw ingest shapes, derived from the test tables."""
