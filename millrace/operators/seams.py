"""Seams for models: scoring, generating and judging stay outside; rows go in, rows with results or errors come out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import softmax


class Model(Protocol):
    def generate(self, prompt: str) -> str: ...

    def score(self, prompt: str, continuation: str) -> float: ...


class Judge(Protocol):
    def score_options(self, response: str, options: list[str]) -> list[float]: ...


def backoff(attempt: int, cap: float = 30.0) -> float:
    return min(2.0**attempt, cap)


def call(df: DataFrame, key: str, prompt: str, make: Callable[[], Model], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, answer, error): one model per partition; a call that keeps failing gives an error row, not a failed job."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt], strict=True):
                answer = error = None
                for attempt in range(retries):
                    try:
                        answer, error = model.generate(p), None
                        break
                    except Exception as e:  # what a remote model may raise is not known here
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < retries:
                            wait(backoff(attempt))
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, error string")


def score_options(df: DataFrame, key: str, prompt: str, options: str, make: Callable[[], Model], temperature: float = 1.0) -> DataFrame:
    """(key, probabilities, best): softmax over the model's score of each option; the first wins a tie."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "scores": [[float(model.score(p, o)) for o in opts] for p, opts in zip(b[prompt], b[options], strict=True)]})

    scored = df.select(key, prompt, options).mapInPandas(run, f"{key} {kind}, scores array<double>")
    return scored.select(key, softmax(F.col("scores"), temperature).alias("probabilities"), (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("best"))


class Merge(Protocol):
    """Pluggable merge of node states; see ``consortium`` for the averages."""

    def combine(self, states: DataFrame) -> DataFrame: ...
