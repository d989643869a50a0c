"""Contamination of documents by test items: exact, n-gram, substring and window overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.session import materialise

#: a side is broadcast, or its hashes sent with the plan, only if it is measured to be no larger
BROADCAST_BYTES = 64 * 1024 * 1024
PLAN_HASHES = 200_000


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """(``df`` written once, its rows, about its bytes)."""
    df = materialise(df)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return df, r.n, int(r.b)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be small in bytes; otherwise as it is, to be joined by shuffle."""
    df, _, size = measured(df)
    return F.broadcast(df) if size <= most else df


def exact_index(items: DataFrame, text: str = "text") -> DataFrame:
    return items.select(F.sha1(X.normalize(F.col(text))).alias("digest")).distinct()


def gram_index(items: DataFrame, n: int = 13, text: str = "text") -> DataFrame:
    return items.select(F.explode(X.ngrams(X.tokens(F.col(text)), n)).alias("gram")).distinct()


def exact_leaks(docs: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("digest", F.sha1(X.normalize(F.col(text)))).join(small(index), "digest", "left_semi").drop("digest")


def gram_leaks(docs: DataFrame, index: DataFrame, key: str, n: int = 13, text: str = "text") -> DataFrame:
    """(key, overlap): documents with at least one n-gram of the index, and how many different ones.

    Each text is cut into words once. Rows without a hash of the index are dropped where
    they are read (the hashes travel with the plan, as a set); only the n-grams of the
    rest leave their row, and they are compared as text. An index with more than
    ``PLAN_HASHES`` n-grams is joined by hash instead.
    """
    index, rows, size = measured(index)
    words = docs.select(key, X.tokens(F.col(text)).alias("w")).where(F.size("w") >= n)
    if rows <= PLAN_HASHES:
        known = [r.h for r in index.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct().collect()]
        # one parsed expression: the words are cut once, and a call a number would take longer than the scan
        among = ", ".join(f"{h}L" if h > -(2**63) else "CAST(-9223372036854775808 AS BIGINT)" for h in known)
        held = f"transform(array({X.tokens_sql(text)}), w -> size(w) >= {n} AND exists(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> xxhash64(slice(w, i, {n})) IN ({among})))[0]"
        near = docs.where(F.expr(held)).select(key, X.tokens(F.col(text)).alias("w")) if known else words.limit(0)
    else:
        hashes = index.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
        ids = words.select(key, F.explode(X.ngram_hashes(F.col("w"), n)).alias("h")).join(hashes, "h", "left_semi").select(key).distinct()
        near = words.join(materialise(ids), key, "left_semi")
    grams = near.select(key, F.explode(X.ngrams(F.col("w"), n)).alias("gram"))
    return grams.join(F.broadcast(index) if size <= BROADCAST_BYTES else index, "gram", "left_semi").groupBy(key).agg(F.countDistinct("gram").alias("overlap"))


def save_index(items: DataFrame, folder: str, n: int = 13, text: str = "text") -> None:
    """Keep the exact and the n-gram index of test items in a folder, for later sessions."""
    exact_index(items, text).write.mode("overwrite").parquet(f"{folder}/exact")
    gram_index(items, n, text).write.mode("overwrite").parquet(f"{folder}/grams")
    items.sparkSession.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/made_with")  # last: an index without it is not whole


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """(exact index, n-gram index, n) as kept by ``save_index``."""
    n = spark.read.parquet(f"{folder}/made_with").first().n
    return spark.read.parquet(f"{folder}/exact"), spark.read.parquet(f"{folder}/grams"), n


def flagged(docs: DataFrame, items: DataFrame, key: str, n: int = 13) -> DataFrame:
    """(key, reason, overlap): why a document is contaminated; exact wins over n-gram."""
    exact = exact_leaks(docs, exact_index(items)).select(key, F.lit("exact").alias("reason"), F.lit(1).cast("long").alias("overlap"))
    grams = gram_leaks(docs, gram_index(items, n), key, n).select(key, F.lit("ngram").alias("reason"), "overlap")
    return exact.distinct().union(grams).groupBy(key).agg(F.min("reason").alias("reason"), F.max("overlap").alias("overlap"))


def substring_leaks(docs: DataFrame, items: DataFrame, key: str, item: str, anchor: int = 5) -> DataFrame:
    """(key, item): the item's joined tokens stand in the document's joined tokens (also inside a longer word at either end).

    All words of an item but the first and last must be whole words of the document,
    so an item of three words or more is found through one run of up to ``anchor`` of its
    inner words. An item of two words is found by the characters around its blank, an
    item of one word by its first three characters. Candidates meet by equality only.
    """
    d = docs.select(key, X.tokens(F.col("text")).alias("w"))
    p = items.select(item, X.tokens(F.col("text")).alias("pw")).where(F.size("pw") > 0).withColumn("pj", F.array_join("pw", " "))
    p, _, size = measured(p)
    joined = F.array_join("w", " ")
    kind = F.when(F.size("pw") > 2, F.least(F.size("pw") - 2, F.lit(anchor))).when(F.size("pw") == 2, 0).otherwise(-F.least(F.length("pj"), F.lit(3)))
    kinds = [r.k for r in p.select(kind.alias("k")).distinct().orderBy("k").collect()]  # at most anchor + 4
    spaced = lambda a, b: F.concat(F.right(a, F.lit(1)), F.lit(" "), F.left(b, F.lit(1)))
    pairs = None
    for k in kinds:
        of = p.where(kind == k)
        if k > 0:
            held, asked = X.ngram_hashes(F.col("w"), k), F.xxhash64(F.slice("pw", 2, k))
        elif k == 0:
            held = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(spaced(a, b)))
            asked = F.xxhash64(spaced(F.get("pw", F.lit(0)), F.get("pw", F.lit(1))))
        else:
            held = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) + k + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(joined, i, F.lit(-k))))
            asked = F.xxhash64(F.left("pj", F.lit(-k)))
        wanted = of.select(item, asked.alias("h"))
        met = d.where(F.size("w") > 0).select(key, F.explode(F.array_distinct(held)).alias("h")).join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "h").select(key, item)
        pairs = met if pairs is None else pairs.union(met)
    if pairs is None:
        return d.join(p.select(item), F.lit(False)).select(key, item)
    near = d.join(pairs.distinct(), key).join(F.broadcast(p.select(item, "pj")) if size <= BROADCAST_BYTES else p.select(item, "pj"), item)
    return near.where(F.contains(joined, F.col("pj"))).select(key, item).distinct()


@F.pandas_udf(T.DoubleType())
def _best_window(words: pd.Series, probe: pd.Series, threshold: pd.Series) -> pd.Series:
    """Largest overlap of the probe's different tokens with a stretch of as many tokens, by one sliding count; 0 where it cannot reach the threshold."""
    out = []
    for w, p, least in zip(words, probe, threshold, strict=True):
        n, target, best = len(p), set(p), 0.0
        if len(w) >= n and len(target.intersection(w)) >= least * len(target) - 1e-9:
            counts: dict[str, int] = {}
            common = 0
            for i, x in enumerate(w):
                c = counts.get(x, 0)
                counts[x] = c + 1
                if not c and x in target:
                    common += 1
                if i >= n:
                    y = w[i - n]
                    if counts[y] == 1:
                        del counts[y]
                        common -= y in target
                    else:
                        counts[y] -= 1
                if i >= n - 1:
                    best = max(best, common / (len(counts) + len(target) - common))
        out.append(best)
    return pd.Series(out, dtype="float64")


def window_leaks(docs: DataFrame, items: DataFrame, key: str, item: str, threshold: float = 0.6) -> DataFrame:
    """(key, item, jaccard): largest token overlap of the item with a stretch of as many tokens, from ``threshold`` on.

    A stretch can only reach the threshold if the document holds at least
    ``ceil(threshold * size)`` of the item's different tokens, so one of its
    ``size - that + 1`` rarest tokens must be there: candidates come from an equi-join
    on those alone, and only they are compared window by window.
    """
    d = docs.select(key, X.tokens(F.col("text")).alias("w"))
    p = items.select(item, X.tokens(F.col("text")).alias("pw")).where(F.size("pw") > 0).withColumn("ps", F.array_distinct("pw"))
    asked = p.select(F.explode("ps").alias("t")).distinct()
    held = d.select(key, F.explode(F.array_distinct("w")).alias("t")).join(small(asked), "t", "left_semi")
    df = held.groupBy("t").agg(F.count("*").alias("df"))
    ranked = p.select(item, F.explode("ps").alias("t")).join(df, "t", "left").groupBy(item).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r"))
    need = F.ceil(F.size("r") * threshold).cast("int")
    rare = ranked.select(item, F.explode(F.slice("r", F.lit(1), F.size("r") - need + 1)).alias("x")).select(item, F.col("x.t").alias("t"))
    pairs = held.join(small(rare), "t").select(key, item).distinct()
    probes = small(p.select(item, "pw"))
    both = pairs.join(d, key).join(probes, item).select(key, item, "w", "pw")
    scored = both.withColumn("best", _best_window("w", "pw", F.lit(threshold))).select(key, item, "best")
    return scored.where(F.col("best") >= threshold).groupBy(key, item).agg(F.max(F.round("best", 3)).alias("jaccard"))
