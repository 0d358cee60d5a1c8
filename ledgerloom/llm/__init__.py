"""Training-data operators: mixing, language-model scoring, search, privacy, deduplication, packing.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
