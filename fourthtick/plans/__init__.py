"""The analytics themselves: shared views, reports, report details and ingest."""
