"""Statistics over runs of an experiment and over corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.numbers import finite, mean0, std0, zscore


def aggregate_runs(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and deviation of each metric per group, finite values only."""
    aggs = [a for m in metrics for a in (mean0(F.col(m)).alias(f"{m}_mean"), std0(F.col(m)).alias(f"{m}_std"))]
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *aggs)


def degenerate(runs: DataFrame, arm: str, seed: str, metrics: list[str]) -> DataFrame:
    """(arm, metric, seeds) of measurements that are not finite."""
    long_ = runs.select(arm, seed, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(arm, seed, "x.*")
    bad = long_.where(F.col("v").isNotNull() & finite(F.col("v")).isNull())
    return bad.groupBy(arm, "metric").agg(F.array_join(F.transform(F.sort_array(F.collect_list(seed)), lambda s: s.cast("string")), ",").alias("seeds"))


def paired_differences(runs: DataFrame, seed: list[str], arm: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(comparison, n, mean, std, z) of ``a - b`` within each seed; an arm that is missing counts as no difference."""
    arms = sorted({x for p in pairs for x in p})
    wide = runs.groupBy(*seed).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])
    rows = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.coalesce(F.col(a) - F.col(b), F.lit(0.0)).alias("d")) for a, b in pairs])
    d = wide.select(F.explode(rows).alias("x")).select("x.*")
    m, s = mean0(F.col("d")), std0(F.col("d"))
    return d.groupBy("comparison").agg(F.count("*").alias("n"), m.alias("mean"), s.alias("std")).withColumn("z", zscore(F.col("mean"), F.col("std")))


def verdict(shift: Column, effect: Column, z: Column, capability_drop: Column, safety_drop: Column, min_shift: float = 0.05, sigma: float = 2.0, max_capability: float = 0.10, max_safety: float = 0.10) -> Column:
    """All four conditions of the decision."""
    return (shift >= min_shift) & (effect > 0) & (z >= sigma) & (capability_drop <= max_capability) & (safety_drop <= max_safety)


def kl_divergence(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """(kl, missing): sum of p ln(p / q) over the categories both have, and p's share outside q."""
    share = lambda df, name: df.groupBy(key).agg(F.count("*").alias("n")).crossJoin(df.agg(F.count("*").alias("t"))).select(key, (F.col("n") / F.col("t")).alias(name))
    both = share(p, "p").join(share(q, "q"), key, "left")
    return both.agg(F.sum(F.when(F.col("q").isNotNull(), F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"), F.sum(F.when(F.col("q").isNull(), F.col("p")).otherwise(0.0)).alias("missing"))


def tfidf_cosine(docs: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """Cosine between the term vectors of every two groups: tf times ln(N / df), N and df over documents."""
    terms = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.explode(X.tokens(F.col(text))).alias("t"))
    per_doc = terms.groupBy("_k", "_g", "t").agg(F.count("*").alias("tf"))
    n = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n"))  # one row
    idf = per_doc.groupBy("t").agg(F.count("*").alias("df")).crossJoin(n).select("t", F.log(F.col("n") / F.col("df")).alias("idf"))
    vec = per_doc.groupBy("_g", "t").agg(F.sum("tf").alias("tf")).join(idf, "t").select("_g", "t", (F.col("tf") * F.col("idf")).alias("w"))
    norms = vec.groupBy("_g").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a, b = vec.select("t", F.col("_g").alias("a"), F.col("w").alias("wa")), vec.select("t", F.col("_g").alias("b"), F.col("w").alias("wb"))
    dots = a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(F.col("_g").alias("a"), F.col("norm").alias("na")), norms.select(F.col("_g").alias("b"), F.col("norm").alias("nb"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", F.when(F.col("na") * F.col("nb") > 0, F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


def cohen_kappa(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, observed, expected, kappa) of two ratings of the same things."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col(x) == F.col(y)).cast("double")).alias("observed"))
    px, py = pairs.groupBy(F.col(x).alias("c")).agg(F.count("*").alias("cx")), pairs.groupBy(F.col(y).alias("c")).agg(F.count("*").alias("cy"))
    same = px.join(py, "c").agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("s"))
    expected = F.try_divide(F.col("s").cast("double"), F.col("n") * F.col("n"))
    return n.crossJoin(same).select("n", "observed", expected.alias("expected"), F.try_divide(F.col("observed") - expected, 1 - expected).alias("kappa"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two paired outcomes and the corrected chi-square."""
    only_a, only_b = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    d = pairs.agg(only_a.alias("only_a"), only_b.alias("only_b"))
    diff = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    return d.select("only_a", "only_b", F.coalesce(F.try_divide(diff * diff, F.col("only_a") + F.col("only_b")), F.lit(0.0)).alias("chi2"))


def length_drift(docs: DataFrame, group: str, text: str) -> DataFrame:
    """Median and 90th percentile of length per group, and their drift from all documents."""
    n = F.length(text)
    whole = docs.where(F.col(text).isNotNull()).agg(F.percentile(n, F.lit(0.5)).alias("m"), F.percentile(n, F.lit(0.9)).alias("q"))
    own = docs.where(F.col(text).isNotNull()).groupBy(group).agg(F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.9)).alias("p90"))
    return own.crossJoin(whole).select(group, "median", "p90", F.abs(F.try_divide(F.col("median"), F.col("m")) - 1).alias("median_drift"), F.abs(F.try_divide(F.col("p90"), F.col("q")) - 1).alias("p90_drift"))


def across_draws(runs: DataFrame, draw: str, arm: str, metrics: list[str]) -> DataFrame:
    """Mean over the seeds of each draw, then mean, deviation and band of each metric over the draws, per arm."""
    per_draw = runs.groupBy(draw, arm).agg(*[mean0(F.col(m)).alias(m) for m in metrics])
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), std0(F.col(m)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    return per_draw.groupBy(arm).agg(F.count("*").alias("draws"), *aggs)


def resampled_verdict(runs: DataFrame, draw: str, arm: str, tried: str, base: str, shift: str, capability: str) -> DataFrame:
    """(draws, effect, z, passed): the decision on the differences within draws; both arms must be in a draw."""
    per_draw = runs.groupBy(draw, arm).agg(mean0(F.col(shift)).alias("s"), mean0(F.col(capability)).alias("c"))
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    d = per_draw.groupBy(draw).agg((pick(tried, "s") - pick(base, "s")).alias("d"), pick(tried, "s").alias("s"), (pick(base, "c") - pick(tried, "c")).alias("drop"))
    a = d.agg(F.count("*").alias("draws"), mean0(F.col("d")).alias("effect"), std0(F.col("d")).alias("sd"), F.avg("s").alias("s"), F.avg("drop").alias("drop"))
    z = zscore(F.col("effect"), F.col("sd"))
    return a.select("draws", "effect", z.alias("z"), verdict(F.col("s"), F.col("effect"), z, F.col("drop"), F.lit(0.0)).alias("passed"))


def token_draws(docs: DataFrame, key: str, group: str, size: str, draws: list[int], fraction: float) -> DataFrame:
    """(draw, *columns): in each seeded draw the documents of a group, in hash order, up to ``fraction`` of its tokens; the one that crosses is in."""
    from millrace.operators.relational import running_budget

    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    whole = docs.groupBy(group).agg((F.sum(size) * fraction).alias("_budget"))
    each = docs.join(whole, group).withColumn("draw", F.explode(F.array(*map(F.lit, draws))))
    each = each.withColumn("_order", F.concat(F.md5(F.concat_ws(":", F.col("draw"), F.col(key))), F.col(key))).withColumn("_key", F.concat_ws(":", F.col("draw"), F.col(group)))
    return running_budget(each, "_key", size, "_order", F.col("_budget"), crossing=True).drop("_order", "_key", "_budget")


def cached_draws(spark: SparkSession, folder: str, draws: list[int], compute: Callable[[int], DataFrame]) -> DataFrame:
    """Results of each draw, computed only where the folder has none yet; a draw is written whole or not at all."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in draws:
        path = f"{folder}/draw={d}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            compute(d).write.mode("overwrite").parquet(path)
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/draw={d}" for d in draws])


def fleiss_kappa(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """(docs, observed, expected, kappa) of yes/no ratings by any number of raters; items with one rating say nothing."""
    r = ratings.groupBy(item).agg(F.count("*").alias("n"), F.count_if(F.col(rating)).alias("k")).where("n > 1")
    agree = (F.col("k") * F.col("k") + (F.col("n") - F.col("k")) * (F.col("n") - F.col("k")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    a = r.agg(F.count("*").alias("docs"), F.avg(agree).alias("observed"), F.try_divide(F.sum("k").cast("double"), F.sum("n")).alias("p"))
    expected = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return a.select("docs", "observed", expected.alias("expected"), F.try_divide(F.col("observed") - expected, 1 - expected).alias("kappa"))
