"""Scans, sinks and maintenance jobs."""
