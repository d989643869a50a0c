"""Resume, merge and selection operators: what an append-only pipeline needs of joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


SALTS = 64
SLICE_DIGITS = 3  # hexadecimal digits of an order that make a slice of it


def pending(queue: DataFrame, done: DataFrame, keys: list[str], answered: str | None = None) -> DataFrame:
    """Queue rows whose key has no (non-empty) result yet."""
    if answered:
        done = done.where(F.col(answered).isNotNull() & (F.col(answered) != ""))
    return queue.join(done.select(*keys).distinct(), keys, "left_anti")


def deficit(targets: DataFrame, have: DataFrame, key: str, target: str) -> DataFrame:
    """What each key still needs: target less what is there, at least 0."""
    counted = have.groupBy(key).agg(F.count("*").alias("have"))
    have_or_0 = F.coalesce("have", F.lit(0))
    return targets.join(counted, key, "left").select(key, target, have_or_0.alias("have"), F.greatest(F.col(target) - have_or_0, F.lit(0)).alias("need"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key: aggregated before the shuffle, no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def override_union(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union in which a later frame overrides earlier ones, and a later row earlier rows, of the same key."""
    ranked = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return latest(together, keys, [F.col("_frame"), *order]).drop("_frame")


def zip_join(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Join by position; columns on both sides take the right value where there is one."""
    shared = [c for c in right.columns if c in left.columns and c != index]
    joined = left.alias("l").join(right.alias("r"), index)
    cols = [F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) if c in shared else F.col(f"l.{c}") for c in left.columns if c != index]
    return joined.select(index, *cols, *[F.col(f"r.{c}") for c in right.columns if c not in shared and c != index])


def quota(df: DataFrame, key: str, order: list[Column], k: Column | int) -> DataFrame:
    """First ``k`` rows of each key in an order.

    A number ``k`` is a limit Spark applies before the shuffle. A column is not, so a key's
    rows are first ranked in ``SALTS`` parts, of which only the first ``k`` of each go on.
    """
    if isinstance(k, Column):
        part = W.partitionBy(key, "_part").orderBy(*order)
        salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).withColumn("_rn", F.row_number().over(part))
        df = salted.where(F.col("_rn") <= k).drop("_part", "_rn")
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def row_index(df: DataFrame, keys: list[str], order: str, bucket: Column, name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of its key: counted by bucket of the order, ranked inside the bucket, so a hot key is spread over its buckets."""
    placed = df.withColumn("_s", bucket)
    counts = placed.groupBy(*keys, "_s").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_t"), before.alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(order)) - 1)
    same = F.col("_s") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(offsets, same).withColumn(name, F.col("_r") + F.col("_before")).select(*df.columns, name)


def key_mismatch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def running_budget(df: DataFrame, key: str, size: str, order: str, budget: Column, crossing: bool) -> DataFrame:
    """Rows of each key, in the order of a hexadecimal hash, up to a budget of ``size``.

    ``crossing`` keeps the row that crosses the budget; without it a row is kept only
    if the budget still holds with it, and the first row always. Running sums are
    taken per slice of the order (its first digits) and then inside the slice, so a
    hot key is spread over 16**SLICE_DIGITS tasks.
    """
    sliced = df.withColumn("_s", F.substring(F.col(order), 1, SLICE_DIGITS)).withColumn("_b", budget)
    sums = sliced.groupBy(key, "_s").agg(F.sum(size).alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy(key).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.join(sums.select(key, "_s", before.alias("_before")), [key, "_s"])
    inside = W.partitionBy(key, "_s").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum(size).over(inside)
    told = placed.withColumn("_upto", upto)
    keep = F.col("_upto") - F.col(size) < F.col("_b") if crossing else (F.col("_upto") <= F.col("_b")) | (F.col("_upto") == F.col(size))
    return told.where(keep).drop("_s", "_b", "_before", "_upto")


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows taking one of each stratum in turn."""
    ranked = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", stratum).limit(n)


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, slice_: Column) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time (of several at one time, the largest), null if there is none.

    The order is cut into slices of time (an expression over ``time``): the last value is
    carried inside a slice by a window, and from slice to slice by one row a slice, so a
    hot key is spread over as many tasks as it has slices.
    """
    rows = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    marks = right.groupBy(key, time).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_slice", slice_)
    ends = both.groupBy(key, "_slice").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_v")), F.when(F.col("_side") == 0, F.col(time))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    inside = F.last("_v", ignorenulls=True).over(W.partitionBy(key, "_slice").orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0))
    told = both.withColumn("_in", inside).join(ends.select(key, "_slice", carried.alias("_before")), [key, "_slice"])
    return told.where("_side = 1").withColumn(value, F.coalesce("_in", "_before")).select(*left.columns, value)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with every interval [lo, hi] they lie in: both meet in bins of ``width`` by equality, so no pair outside a bin is looked at.

    An interval has a row for each bin it reaches within the span of the points.
    """
    span = points.agg(F.min(point).alias("_a"), F.max(point).alias("_z"))  # one row
    bins = intervals.crossJoin(span).where(F.col(lo) <= F.least(hi, "_z")).where(F.greatest(lo, "_a") <= F.least(hi, "_z"))
    bins = bins.withColumn("_bin", F.explode(F.sequence(F.floor(F.greatest(lo, "_a") / width), F.floor(F.least(hi, "_z") / width)))).drop("_a", "_z")
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(bins, "_bin").where(F.col(point).between(F.col(lo), F.col(hi))).drop("_bin")


def lineage(nodes: DataFrame, parents: DataFrame, node: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """(node, root, depth) by pointer doubling: rounds grow with the logarithm of the longest line of parents; a circle raises."""
    from millrace.session import checkpoint

    state = checkpoint(nodes.join(parents, node, "left").select(node, F.coalesce(parent, node).alias("root"), F.col(parent).isNotNull().cast("long").alias("depth")))
    seen = None
    for _ in range(most_rounds):
        total = state.agg(F.sum("depth")).first()[0]
        if total == seen:
            return state
        seen = total
        up = state.select(F.col(node).alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more"))
        state = checkpoint(state.join(up, "root").select(node, F.col("_up").alias("root"), (F.col("depth") + F.col("_more")).alias("depth")))
    raise RuntimeError("the parents go round in a circle")


def replay_size(rows: int, fraction: float, pool: int) -> int:
    """Rows to take from a pool so that they are ``fraction`` (0 to 0.95) of the mix; halves go to the even number."""
    f = min(max(fraction, 0.0), 0.95)
    return min(max(round(rows * f / (1 - f)), 1), pool)


def share_of_each(df: DataFrame, key: str, order: str, tie: str, share: float) -> DataFrame:
    """First ``share`` (rounded up) of the rows of each key in the order of a hexadecimal hash, ranked slice by slice of the order."""
    sliced = df.withColumn("_s", F.substring(F.col(order), 1, SLICE_DIGITS))
    counts = sliced.groupBy(key, "_s").agg(F.count("*").alias("_m"))
    by = W.partitionBy(key)
    before = F.coalesce(F.sum("_m").over(by.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.join(counts.select(key, "_s", before.alias("_before"), F.ceil(F.sum("_m").over(by) * share).alias("_k")).where("_before < _k"), [key, "_s"])
    rank = F.row_number().over(W.partitionBy(key, "_s").orderBy(order, tie)) + F.col("_before")
    return placed.withColumn("_r", rank).where("_r <= _k").select(*df.columns)


def without_repeated_lines(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, removed, text): texts without the lines that ``least`` or more keys have; blank lines stay."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_line")).withColumn("_t", F.trim("_line"))
    common = lines.where("_t <> ''").select(key, "_t").distinct().groupBy("_t").agg(F.count("*").alias("_df")).where(F.col("_df") >= least).select("_t", F.lit(True).alias("_drop"))
    told = lines.join(common, "_t", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("_drop").isNull(), F.struct("_i", "_line"))))
    return told.groupBy(key).agg(F.count("_drop").alias("removed"), F.array_join(F.transform(kept, lambda x: x["_line"]), "\n").alias(text))
