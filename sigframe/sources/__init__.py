"""Scans, catalogue readers and sinks."""
