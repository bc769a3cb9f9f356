"""Commerce analytics on Spark: ingest, staging, star schema, reports, checks."""
