"""Ledgerloom: telecom billing documents to typed, queryable tables on Spark."""
