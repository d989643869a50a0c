"""Numeric column builders: robust statistics, softmax, distances, schedules, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def mean0(c: Column) -> Column:
    """Mean of the finite values, 0 without any."""
    return F.coalesce(F.avg(finite(c)), F.lit(0.0))


def std0(c: Column) -> Column:
    """Sample deviation of the finite values, 0 with fewer than two."""
    return F.coalesce(F.stddev_samp(finite(c)), F.lit(0.0))


def zscore(mean: Column, std: Column) -> Column:
    return F.when(std > 0, mean / std).when(mean > 0, INF).when(mean < 0, -INF).otherwise(0.0)


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / F.when(total == 0, 1.0).otherwise(total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clipped_scale(x: Column, full: float = 2.5) -> Column:
    return F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / full)), 2)


def ratio_deviation(a: Column, b: Column) -> Column:
    """|1 - a / b|, null if b is 0."""
    return F.abs(1 - F.try_divide(a, b))


def warmup_decay(step: Column, total: int, warmup: int) -> Column:
    """Linear warm-up, then linear decay to 0; constant 1 without warm-up."""
    if warmup <= 0:
        return F.lit(1.0)
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(total - warmup, 1)))))


def backoff(attempt: Column, cap: float = 30.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(cap))


def trend(delta: Column, flat: float = 0.0, up: str = "rising", down: str = "falling") -> Column:
    return F.when(delta > flat, up).when(delta < -flat, down).otherwise("flat")


def lag_verdict(lag: Column, close: float = 0.05) -> Column:
    return F.when(F.abs(lag) < close, "matched").when(lag > 0, "ahead").otherwise("behind")


def expectation(p: Column, values: Column) -> Column:
    """Sum of the values times their probabilities."""
    return F.aggregate(F.zip_with(p, values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def mean_of(xs: Column) -> Column:
    """Mean of an array, null if it is empty."""
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))
