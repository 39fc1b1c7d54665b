"""Where queries and their SQL oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a query; without SQL it has a NumPy or sequential oracle in the tests."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    """Rounded to six places, so that summation order does not show."""
    return F.round(c, 6)
