"""Incremental ingest and event-time operators on Structured Streaming."""
