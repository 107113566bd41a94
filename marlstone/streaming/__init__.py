"""Structured Streaming: ingestion of files into tables, and the work queue as a stateful fold."""
