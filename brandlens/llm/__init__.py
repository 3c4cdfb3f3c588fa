"""Training-data operators: mixing, scoring, counting, dedup, sharding, quality, language.

Nothing outside this package imports it; ``queries.py`` holds the query registry.
"""
