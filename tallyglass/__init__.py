"""Spark operators and jobs for first-party web and content analytics."""
