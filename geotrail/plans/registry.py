"""Registered queries of the engine's own operators with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, keep: str, metres: str = "", degrees: str = "") -> DataFrame:
    """Columns as they are, at 6 places and at 8; adding zero leaves no negative one."""
    return df.select(*keep.split(), *[(F.round(c, 6) + 0.0).alias(c) for c in metres.split()], *[(F.round(c, 8) + 0.0).alias(c) for c in degrees.split()])


def rounded_sql(keep: str, metres: str = "", degrees: str = "") -> str:
    return ", ".join([*keep.split(), *[f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in metres.split()], *[f"round({c}, 8) + 0.0::DOUBLE AS {c}" for c in degrees.split()]])


def load():
    """This module, with the queries of all modules in it."""
    import sys

    from . import queries_paths, queries_retrieval, queries_stream  # noqa: F401

    return sys.modules[__name__]
