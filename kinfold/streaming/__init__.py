"""Incremental ingest by micro-batches."""
