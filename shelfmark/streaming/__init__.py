"""Structured Streaming forms of the telemetry and ingest jobs."""
