"""Corpus controls: per-document rules of an arm, matched twins, balancing, drawn subsets.

Checks return rows of violations; ``strict`` turns the first of them into an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.numbers import ratio_deviation

REQUIRED = ["id", "text", "source", "license", "lang"]


class CorpusError(ValueError):
    pass


def missing_fields(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Names of required fields that are null or empty."""
    return F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in fields or REQUIRED]), lambda x: x.isNotNull())


def year_allowed(year: Column, low: Column, high: Column) -> Column:
    return year.isNull() | (F.coalesce(year >= low, F.lit(True)) & F.coalesce(year <= high, F.lit(True)))


def arm_documents(docs: DataFrame, arms: DataFrame) -> DataFrame:
    """Documents of each declared arm: its language and domains."""
    a = arms.select("culture", "arm", F.lower(F.trim("lang")).alias("_lang"), F.explode("domains").alias("_domain"), "min_year", "max_year")
    d = docs.withColumn("_lang", F.lower(F.trim("lang"))).withColumn("_domain", F.lower(F.trim("domain")))
    return d.join(a, ["_lang", "_domain"]).drop("_lang", "_domain")


def _has_text(armed: DataFrame) -> Column:
    return F.col("has_text") if "has_text" in armed.columns else X.present(F.col("text")).isNotNull()


def violations(armed: DataFrame, key: str = "id") -> DataFrame:
    """(culture, arm, key, rule): each rule a document of an arm breaks."""
    rules = F.array(
        F.when(~F.coalesce(X.canonical_license(F.col("license")).isin(X.OPEN_LICENSES), F.lit(False)), "license"),
        F.when(~year_allowed(F.col("year"), F.col("min_year"), F.col("max_year")), "year"),
        F.when(~_has_text(armed), "text"),
    )
    return armed.select("culture", "arm", key, F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def control_report(armed: DataFrame, key: str = "id") -> DataFrame:
    """One row per arm: documents, tokens and broken rules."""
    license_ok = F.coalesce(X.canonical_license(F.col("license")).isin(X.OPEN_LICENSES), F.lit(False))
    return armed.groupBy("culture", "arm").agg(
        F.count("*").alias("docs"),
        F.sum("n_tokens" if "n_tokens" in armed.columns else X.token_count(F.col("text"))).alias("tokens"),
        F.count_if(~license_ok).alias("bad_license"),
        F.count_if(~year_allowed(F.col("year"), F.col("min_year"), F.col("max_year"))).alias("bad_year"),
        F.count_if(~_has_text(armed)).alias("no_text"),
    )


def assert_valid(found: DataFrame, what: str) -> None:
    """Raise with the first three violations."""
    head = found.limit(3).collect()
    if head:
        raise CorpusError(f"{what}: " + "; ".join(str(r.asDict()) for r in head))


def twin_report(arms: DataFrame, sizes: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Per culture: do the two arms differ in grounding only? ``sizes`` has culture, arm, tokens."""
    a = arms.join(sizes, ["culture", "arm"], "left")
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm[0]}_{c}")
    wide = a.groupBy("culture").agg(*[pick(arm, c) for arm in ("grounded", "language_matched") for c in ("lang", "register", "value_laden", "tokens", "token_ratio_tolerance")])
    deviation = ratio_deviation(F.coalesce("g_tokens", F.lit(0)).cast("double"), F.coalesce("l_tokens", F.lit(0)).cast("double"))
    allowed = F.coalesce("g_token_ratio_tolerance", F.lit(tolerance))
    return wide.select(
        "culture",
        F.coalesce(F.col("g_lang") == F.col("l_lang"), F.lit(False)).alias("same_lang"),
        F.coalesce(F.col("g_register") == F.col("l_register"), F.lit(False)).alias("same_register"),
        (~(F.coalesce(~F.col("g_value_laden"), F.lit(False)) | F.coalesce(F.col("l_value_laden"), F.lit(False)))).alias("values_ok"),
        F.round(deviation, 6).alias("deviation"),
        F.coalesce(deviation <= allowed, F.lit(False)).alias("size_ok"),
    )


def balanced_lengths(sizes: dict[str, dict[str, int]], tolerance: float, least: int = 20, most: int = 1000) -> dict[str, dict[str, int]]:
    """Trim the longest document of the larger arm to nine tenths until the arms' sizes agree.

    ``sizes`` maps two arms to {document: words}, for corpora a driver holds (one culture's
    pair of arms). Stops when the longest document has at most ``least`` words; raises if
    ``most`` cuts do not do.
    """
    out = {arm: dict(docs) for arm, docs in sizes.items()}
    total = {arm: sum(docs.values()) for arm, docs in out.items()}
    heaps = {arm: [(-n, d) for d, n in docs.items()] for arm, docs in out.items()}
    for h in heaps.values():
        heapq.heapify(h)
    first, second = list(out)
    for _ in range(most):
        if not total[first] or not total[second] or abs(1 - total[first] / total[second]) <= tolerance:
            break
        arm = first if total[first] > total[second] else second
        n, doc = -heaps[arm][0][0], heaps[arm][0][1]
        if n <= least:
            break
        cut = int(n * 0.9)
        heapq.heapreplace(heaps[arm], (-cut, doc))
        out[arm][doc] = cut
        total[arm] += cut - n
    else:
        raise CorpusError(f"arms not balanced after {most} cuts")
    return out
