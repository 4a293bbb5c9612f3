"""Registered queries: each a Spark plan and an independent SQL statement."""

from __future__ import annotations

import functools

from tidemark.sources.scratch import written

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SHARED: dict = {}


def shared(f):
    """A function (spark, sf_dir) -> DataFrame whose frame is written once for the query that is being built; whatever
    else the query builds on it reads the written rows. So plans do not nest, however many steps a query has."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        key = (f.__module__, f.__name__, sf_dir)
        if key not in _SHARED:
            _SHARED[key] = written(f(spark, sf_dir), f.__name__.strip("_"))
        return _SHARED[key]

    return run


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            _SHARED.clear()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
