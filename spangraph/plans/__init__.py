"""Registered queries: each module holds ``QUERIES`` (name to Spark) and ``ORACLES`` (name to SQL)."""
