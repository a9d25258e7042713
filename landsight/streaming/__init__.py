"""Structured Streaming: the daily network update."""
