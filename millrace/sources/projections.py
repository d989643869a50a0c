"""Text projections: what of a source's row is compared with other texts.

A registry names for each source the kind of its rows and the columns they are in; a
kind is one column expression. Rows without text give none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def plain(*columns: Column) -> Column:
    """The parts that are there, a line each."""
    return X.present(F.concat_ws("\n", *[X.present(c) for c in columns]))


def with_options(question: Column, options: Column) -> Column:
    """A question and its options, a line each."""
    return X.present(F.concat_ws("\n", X.present(question), F.array_join(options, "\n")))


def turns(messages: Column) -> Column:
    """The contents of all turns, a line each."""
    return X.present(F.array_join(F.filter(F.transform(messages, lambda m: X.present(m["content"])), lambda t: t.isNotNull()), "\n"))


def passages(question: Column, titles: Column, sentences: Column) -> Column:
    """A question after the passages it is asked about."""
    return X.present(F.concat_ws("\n", X.passages(titles, sentences), X.present(question)))


KINDS: dict[str, Callable[..., Column]] = {"plain": plain, "options": with_options, "turns": turns, "passages": passages}


def project(df: DataFrame, key: str, kind: str, columns: list[str]) -> DataFrame:
    """(key, text) of the rows that have text."""
    return df.select(F.col(key).cast("string").alias("key"), KINDS[kind](*map(F.col, columns)).alias("text")).where("text IS NOT NULL")


def project_all(sources: dict[str, DataFrame], registry: dict[str, tuple[str, str, list[str]]]) -> DataFrame:
    """(source, key, text) of all registered sources: source -> (key, kind, columns); a registered source without a table is an error."""
    missing = sorted(set(registry) - set(sources))
    if missing:
        raise KeyError(f"no table for {', '.join(missing)}")
    parts = [project(sources[name], key, kind, columns).select(F.lit(name).alias("source"), "key", "text") for name, (key, kind, columns) in registry.items()]
    return reduce(DataFrame.union, parts)
