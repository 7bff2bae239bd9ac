"""Spark-first medallion library: nested ingest, star building, quality checks, record extraction."""
