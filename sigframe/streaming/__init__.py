"""Structured Streaming operators, keyed by stream."""
