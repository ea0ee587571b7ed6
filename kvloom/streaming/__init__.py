"""Structured Streaming forms of counters and writes."""
