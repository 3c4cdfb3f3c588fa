"""Orchestrated jobs and the query catalogue on the driver tables."""
