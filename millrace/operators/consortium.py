"""Contribution weights, weight averages and merge diagnostics over long tables of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.numbers import finite


def contribution_weights(scores: DataFrame, group: list[str], node: str, score: str, floor: float, cap: float, equal: bool = False) -> DataFrame:
    """Weight of each accepted node of a group.

    Nodes under the floor, at or below 0 or not finite are rejected. Shares are
    proportional to the scores; what exceeds the cap is redistributed to the others in
    proportion, again and again, and weights are scaled to sum 1. The nodes that end at
    the cap are the k highest, for the smallest k at which the next one's share of the
    rest stays within the cap, so the repetition has a closed form over running sums.
    """
    if not 0 < cap <= 1:
        raise ValueError("cap must lie in (0, 1]")
    by = W.partitionBy(*group)
    down = by.orderBy(F.desc(score), node)
    accepted = scores.where(finite(F.col(score)).isNotNull() & (F.col(score) >= floor) & (F.col(score) > 0))
    if equal:
        return accepted.select(*group, node, (1 / F.count("*").over(by)).alias("weight"))
    ranked = accepted.withColumn("_r", F.row_number().over(down) - 1).withColumn("_rest", F.sum(score).over(down.rowsBetween(0, W.unboundedFollowing)))
    # share the node would have if all before it were capped
    share = F.col(score) * (1 - F.col("_r") * cap) / F.col("_rest")
    told = ranked.withColumn("_k", F.min(F.when(share <= cap, F.col("_r"))).over(by)).withColumn("_n", F.count("*").over(by))
    told = told.withColumn("_k", F.coalesce("_k", "_n"))
    rest = F.sum(F.when(F.col("_r") >= F.col("_k"), F.col(score))).over(by)
    raw = F.when(F.col("_r") < F.col("_k"), F.lit(cap)).otherwise(F.col(score) * (1 - F.col("_k") * cap) / rest)
    return told.withColumn("_w", raw).select(*group, node, (F.col("_w") / F.sum("_w").over(by)).alias("weight"))


def distinct_cells(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per cell: repeated rows count once, null and NaN cells are missing."""
    return values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.max(value).alias(value))


def weighted_average(values: DataFrame, weights: DataFrame, node: str, cell: list[str], value: str, weight: str = "weight", group: list[str] | None = None) -> DataFrame:
    """Sum of value times weight per cell over the nodes that have a weight, divided by the weights present."""
    group = group or []
    joined = values.join(weights, [*group, node])
    total = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return joined.groupBy(*group, *cell).agg(total.alias("average"), F.count("*").alias("nodes"))


def uniform_average(values: DataFrame, node: str, cell: list[str], value: str, is_float: str) -> DataFrame:
    """Mean per cell; a cell that holds no floats keeps the value of the first node."""
    average = F.when(F.max(F.col(is_float).cast("int")) == 1, F.avg(value)).otherwise(F.min_by(value, node))
    return values.groupBy(*cell).agg(average.alias("average"))


def delta_norm(before: DataFrame, after: DataFrame, keys: list[str], cell: list[str], value: str) -> DataFrame:
    """Euclidean norm of the change of a state, per key; cells on one side only are counted apart."""
    b, a = before.withColumnRenamed(value, "_b"), after.withColumnRenamed(value, "_a")
    joined = b.join(a, [*keys, *cell], "full_outer")
    d = F.col("_a") - F.col("_b")
    return joined.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("norm"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))


def merge_diagnostics(start: DataFrame, forks: DataFrame, node: str, cell: list[str], value: str, group: list[str] | None = None) -> DataFrame:
    """(mean pairwise cosine, sign agreement, retained share of the update) of the forks' changes, per group.

    Pairs are never built: over all cells the square of the summed changes is the sum of
    all squares and twice all products, and likewise for changes of unit length, whose
    products are the cosines. A node without change has cosine 0 with all others.
    """
    by = group or []
    cell = [*by, *cell]
    delta = forks.join(start.withColumnRenamed(value, "_s"), cell).select(node, *cell, (F.col(value) - F.col("_s")).alias("d"))
    sq = delta.groupBy(*by, node).agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    norms = sq.groupBy(*by).agg(F.avg(F.sqrt("sq")).alias("mean_norm"), F.count("*").alias("n"), F.count_if(F.col("sq") > 0).alias("moved"))
    unit = F.when(F.col("sq") > 0, F.col("d") / F.sqrt("sq")).otherwise(0.0)
    sums = delta.join(sq, [*by, node]).groupBy(*cell).agg(F.sum("d").alias("d"), F.sum(unit).alias("u"), F.abs(F.sum(F.signum("d"))).alias("s"))
    whole = sums.groupBy(*by).agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.avg("s").alias("s"))
    joined = norms.join(whole, by, "left") if by else norms.crossJoin(whole)  # one row a group each
    pairs = F.col("n") * (F.col("n") - 1)
    return joined.select(
        *by,
        F.when(pairs > 0, (F.col("uu") - F.col("moved")) / pairs).otherwise(0.0).alias("mean_cosine"),
        F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("sign_agreement"),
        F.when(F.col("mean_norm") > 0, F.sqrt("dd") / F.col("n") / F.col("mean_norm")).otherwise(0.0).alias("retained"),
    )


def accepted_and_rejected(scores: DataFrame, group: list[str], node: str, score: str, floor: float) -> DataFrame:
    """Per group the accepted and rejected nodes in order."""
    ok = finite(F.col(score)).isNotNull() & (F.col(score) >= floor) & (F.col(score) > 0)
    pick = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col(node)))), ",")
    return scores.groupBy(*group).agg(pick(ok).alias("accepted"), pick(~F.coalesce(ok, F.lit(False))).alias("rejected"))


def rounds(scores: DataFrame, values: DataFrame, floor: float, cap: float, value: Column | None = None) -> DataFrame:
    """Every round's governed average per cell, all rounds at once.

    A round's weights depend on its own scores alone, so the rounds are one grouped
    computation; a round without accepted nodes gives no rows (the state before it holds).
    """
    score = scores.groupBy("node_id", "round_num").agg(F.max("quality").alias("quality"))
    weights = contribution_weights(score, ["round_num"], "node_id", "quality", floor, cap).withColumnRenamed("node_id", "node")
    cells = distinct_cells(values, ["node", "round_num", "tensor", "idx"], "value")
    return weighted_average(cells, weights, "node", ["tensor", "idx"], "value", group=["round_num"])
