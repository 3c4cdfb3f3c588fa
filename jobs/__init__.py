"""Runnable jobs: ``python -m jobs.NAME --help``. Each module has a function that takes a session, and its command line."""
