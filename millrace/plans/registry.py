"""Registry of core queries and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def norm_sql(c: str) -> str:
    """SQL of ``functions.text.normalize``."""
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split({norm_sql(c)}, ' '), lambda x: x <> '')"


def words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(trim({c}), '[\s\x0B]+'), lambda x: x <> '')"
