"""Structured Streaming forms of ingest and of the hourly volume report."""
