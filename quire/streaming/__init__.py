"""Structured Streaming forms of the ingest and of the panel; each has a batch twin with the same rows."""
