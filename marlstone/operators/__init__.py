"""Operators on DataFrames: envelopes, idempotent ingestion, and the work queue."""
