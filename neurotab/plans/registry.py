"""Registers queries with their SQL by module."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): the decorator puts a function into queries and its SQL into oracles."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query


def table(name: str):
    """A reader of one of the given tables."""
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")
