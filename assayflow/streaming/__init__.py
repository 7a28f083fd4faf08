"""Structured Streaming forms of the poll loops: landing, alerts, freshness, counts, chunks."""
