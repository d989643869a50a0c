"""Queries over vectors, weight tables and the survey projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import numbers as N
from millrace.functions import survey as V
from millrace.operators import consortium as K
from millrace.plans.registry import query
from millrace.session import table

_SCORES = "SELECT round_num, node_id, max(quality) AS quality FROM contribution_scores WHERE quality IS NOT NULL AND NOT isnan(quality) AND NOT isinf(quality) AND quality >= 0.6 AND quality > 0 GROUP BY 1, 2"
#: running-sum form of repeated capping, cap 0.3
_WEIGHTS = f"""SELECT round_num, node_id, w / sum(w) OVER (PARTITION BY round_num) AS weight FROM (
    SELECT *, CASE WHEN r < k THEN 0.3 ELSE quality * (1 - k * 0.3) / sum(CASE WHEN r >= k THEN quality END) OVER (PARTITION BY round_num) END AS w FROM (
    SELECT *, coalesce(min(CASE WHEN quality * (1 - r * 0.3) / rest <= 0.3 THEN r END) OVER (PARTITION BY round_num), count(*) OVER (PARTITION BY round_num)) AS k FROM (
    SELECT *, row_number() OVER d - 1 AS r, sum(quality) OVER (PARTITION BY round_num ORDER BY quality DESC, node_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({_SCORES}) WINDOW d AS (PARTITION BY round_num ORDER BY quality DESC, node_id))))"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "contribution_scores").where(N.finite(F.col("quality")).isNotNull())
    return s.groupBy("round_num", "node_id").agg(F.max("quality").alias("quality"))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return K.contribution_weights(_scores(spark, sf), ["round_num"], "node_id", "quality", 0.6, 0.3)


@query(f"SELECT round_num, node_id, round(weight, 9) AS weight FROM ({_WEIGHTS})")
def x01_contribution_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select("round_num", "node_id", F.round("weight", 9).alias("weight"))


@query(f"SELECT round_num, node_id, round(1.0 / count(*) OVER (PARTITION BY round_num), 9) AS weight FROM ({_SCORES})")
def x03_equal_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = K.contribution_weights(_scores(spark, sf), ["round_num"], "node_id", "quality", 0.6, 0.3, equal=True)
    return w.select("round_num", "node_id", F.round("weight", 9).alias("weight"))


_ALL = "SELECT round_num, node_id, max(quality) FILTER (NOT isnan(quality) AND NOT isinf(quality)) AS q FROM contribution_scores GROUP BY 1, 2"


@query(f"SELECT round_num, coalesce(string_agg(node_id, ',' ORDER BY node_id) FILTER (q >= 0.6 AND q > 0), '') AS accepted, coalesce(string_agg(node_id, ',' ORDER BY node_id) FILTER (NOT coalesce(q >= 0.6 AND q > 0, false)), '') AS rejected FROM ({_ALL}) GROUP BY round_num")
def x02_accepted_rejected(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "contribution_scores").groupBy("round_num", "node_id").agg(F.max(N.finite(F.col("quality"))).alias("q"))
    return K.accepted_and_rejected(s, ["round_num"], "node_id", "q", 0.6)


@query(f"SELECT round_num, round(coalesce(max(weight), 0), 9) AS max_weight, count(*) AS accepted FROM ({_WEIGHTS}) GROUP BY round_num")
def a24_max_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).groupBy("round_num").agg(F.round(F.coalesce(F.max("weight"), F.lit(0.0)), 9).alias("max_weight"), F.count("*").alias("accepted"))


_CELLS = "SELECT node, round_num, tensor, idx, max(value) AS value, bool_or(is_float) AS is_float FROM node_weights WHERE value::VARCHAR <> 'nan' GROUP BY 1, 2, 3, 4"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "node_weights").where("value IS NOT NULL AND NOT isnan(value)")
    return v.groupBy("node", "round_num", "tensor", "idx").agg(F.max("value").alias("value"), F.bool_or("is_float").alias("is_float"))


@query(f"SELECT c.round_num, c.tensor, c.idx, round(sum(c.value * w.weight) / sum(w.weight), 4) AS average, count(*) AS nodes FROM ({_CELLS}) c JOIN ({_WEIGHTS}) w ON w.node_id = c.node AND w.round_num = c.round_num GROUP BY 1, 2, 3")
def a19_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    a = K.rounds(table(spark, sf, "contribution_scores").where(N.finite(F.col("quality")).isNotNull()), table(spark, sf, "node_weights"), 0.6, 0.3)
    return a.select("round_num", "tensor", "idx", F.round("average", 4).alias("average"), "nodes")


@query(f"SELECT round_num, tensor, idx, round(CASE WHEN bool_or(is_float) THEN avg(value) ELSE arg_min(value, node) END, 4) AS average FROM ({_CELLS}) GROUP BY 1, 2, 3")
def a20_uniform_average(spark: SparkSession, sf: str) -> DataFrame:
    a = K.uniform_average(_cells(spark, sf), "node", ["round_num", "tensor", "idx"], "value", "is_float")
    return a.select("round_num", "tensor", "idx", F.round("average", 4).alias("average"))


@query(
    f"""WITH c AS ({_CELLS}), w AS (SELECT node, round_num, count(*) AS m FROM c GROUP BY 1, 2) SELECT c.round_num, c.tensor, c.idx, round(sum(c.value * w.m) / sum(w.m), 4) AS average FROM c JOIN w USING (node, round_num) GROUP BY 1, 2, 3"""
)
def a21_soup(spark: SparkSession, sf: str) -> DataFrame:
    """Average under weights that are scaled to sum 1 (here: cells a node reported)."""
    c = _cells(spark, sf)
    w = c.groupBy("node", "round_num").agg(F.count("*").alias("weight"))
    a = K.weighted_average(c.drop("is_float"), w, "node", ["tensor", "idx"], "value", group=["round_num"])
    return a.select("round_num", "tensor", "idx", F.round("average", 4).alias("average"))


_FOLLOWS = "round_num IN (SELECT round_num FROM c) AND round_num - 1 IN (SELECT round_num FROM c)"


def _successive(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of the round before under the number of the round they precede, cells of the round); a round without one before it is left out."""
    r = cells.select("round_num").distinct()
    both = r.join(r.select((F.col("round_num") + 1).alias("round_num")), "round_num")
    return tuple(c.join(both, "round_num", "left_semi") for c in (cells.withColumn("round_num", F.col("round_num") + 1), cells))


@query(
    f"""WITH c AS ({_CELLS}), b AS (SELECT node, tensor, idx, round_num + 1 AS round_num, value FROM c)
    SELECT round_num, node, tensor, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS norm, count(*) FILTER (a.value IS NULL OR b.value IS NULL) AS unmatched
    FROM (SELECT * FROM b WHERE {_FOLLOWS}) b FULL JOIN (SELECT * FROM c WHERE {_FOLLOWS}) a USING (round_num, node, tensor, idx) GROUP BY 1, 2, 3"""
)
def a22_delta_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Change of every round against the one before it."""
    b, a = _successive(_cells(spark, sf).select("node", "tensor", "idx", "round_num", "value"))
    d = K.delta_norm(b, a, ["round_num", "node", "tensor"], ["idx"], "value")
    return d.select("round_num", "node", "tensor", F.round("norm", 6).alias("norm"), "unmatched")


@query(
    f"""WITH c AS ({_CELLS}), s AS (SELECT round_num + 1 AS round_num, tensor, idx, avg(value) AS s FROM c WHERE is_float GROUP BY 1, 2, 3), d AS (SELECT round_num, c.node, tensor, idx, c.value - s.s AS d FROM c JOIN s USING (round_num, tensor, idx)),
    q AS (SELECT round_num, node, sum(d * d) AS sq FROM d GROUP BY 1, 2), p AS (SELECT round_num, a.node AS i, b.node AS j, sum(a.d * b.d) AS dot FROM d a JOIN d b USING (round_num, tensor, idx) WHERE a.node < b.node GROUP BY 1, 2, 3),
    co AS (SELECT p.round_num, avg(CASE WHEN x.sq > 0 AND y.sq > 0 THEN dot / sqrt(x.sq * y.sq) ELSE 0 END) AS c, sum(dot) AS dots FROM p JOIN q x ON x.round_num = p.round_num AND x.node = p.i JOIN q y ON y.round_num = p.round_num AND y.node = p.j GROUP BY 1),
    n AS (SELECT round_num, sum(sq) AS ss, avg(sqrt(sq)) AS mn, count(*) AS n FROM q GROUP BY 1), g AS (SELECT round_num, avg(abs(t) / n) AS a FROM (SELECT round_num, sum(sign(d)) AS t FROM d GROUP BY round_num, tensor, idx) JOIN n USING (round_num) GROUP BY 1)
    SELECT round_num, round(coalesce(c, 0), 6) AS mean_cosine, round(a, 6) AS sign_agreement, round(CASE WHEN mn > 0 THEN sqrt(greatest(ss + 2 * coalesce(dots, 0), 0) / (n * n)) / mn ELSE 0 END, 6) AS retained FROM n JOIN g USING (round_num) LEFT JOIN co USING (round_num)"""
)
def a23_merge_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics of every round, the forks held against the mean of the round before."""
    c = _cells(spark, sf)
    start = c.where("is_float").groupBy((F.col("round_num") + 1).alias("round_num"), "tensor", "idx").agg(F.avg("value").alias("value"))
    m = K.merge_diagnostics(start, c.select("node", "round_num", "tensor", "idx", "value"), "node", ["tensor", "idx"], "value", group=["round_num"])
    return m.select("round_num", *[F.round(x, 6).alias(x) for x in m.columns if x != "round_num"])


@query(f"WITH c AS ({_CELLS}) SELECT node, round_num, count(*) AS cells, count(DISTINCT tensor) AS tensors FROM c GROUP BY 1, 2")
def j18_states(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).groupBy("node", "round_num").agg(F.count("*").alias("cells"), F.countDistinct("tensor").alias("tensors"))


_DIMS = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"


def _dims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH d AS ({_DIMS}), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2), v AS (SELECT d.label, d.vec_id, sqrt(sum((d.x - c.m) * (d.x - c.m))) AS r FROM d JOIN c USING (label, i) GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(r), 5) AS spread FROM v GROUP BY label")
def a17_centroid_spread(spark: SparkSession, sf: str) -> DataFrame:
    d = _dims(spark, sf)
    c = d.groupBy("label", "i").agg(F.avg("x").alias("m"))
    v = d.join(c, ["label", "i"]).groupBy("label", "vec_id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("r"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("spread"))


@query(f"WITH d AS ({_DIMS}), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS r FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg(r), 5) AS mean_distance FROM p")
def a18_pairwise_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of every two class centroids (pairs of classes, not of rows)."""
    c = _dims(spark, sf).groupBy("label", "i").agg(F.avg("x").alias("m"))
    a, b = c.select("i", F.col("label").alias("a"), F.col("m").alias("ma")), c.select("i", F.col("label").alias("b"), F.col("m").alias("mb"))
    p = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))).alias("r"))
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg("r"), 5).alias("mean_distance"))


@query(f"WITH d AS ({_DIMS}), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2) SELECT d.vec_id, round(sum(d.x * c.m) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.m * c.m))), 5) AS cosine FROM d JOIN c USING (label, i) GROUP BY d.vec_id")
def g07_cosine(spark: SparkSession, sf: str) -> DataFrame:
    d = _dims(spark, sf)
    j = d.join(d.groupBy("label", "i").agg(F.avg("x").alias("m")), ["label", "i"])
    return j.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * F.col("m")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("m") * F.col("m")))), 5).alias("cosine"))


_UNIT = f"SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM ({_DIMS})"


@query(
    f"""WITH u AS ({_UNIT}), p AS (SELECT i, m / sqrt(sum(m * m) OVER ()) AS m FROM (SELECT i, avg(x) AS m FROM u WHERE label = 1 GROUP BY i)), n AS (SELECT i, m / sqrt(sum(m * m) OVER ()) AS m FROM (SELECT i, avg(x) AS m FROM u WHERE label = 0 GROUP BY i)),
    c AS (SELECT greatest(1e-6, 1 - sum(p.m * n.m)) AS d FROM p JOIN n USING (i)) SELECT u.vec_id, round(greatest(-1, least(1, sum(u.x * (p.m - n.m)) / any_value(c.d))), 5) AS lean FROM u JOIN p USING (i) JOIN n USING (i), c GROUP BY u.vec_id"""
)
def g08_axis_lean(spark: SparkSession, sf: str) -> DataFrame:
    """Lean of every vector between the centroids of label 0 and label 1, poles at -1 and 1."""
    d = _dims(spark, sf)
    length = d.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    u = d.join(length, "vec_id").select("vec_id", "label", "i", F.when(F.col("len") > 0, F.col("x") / F.col("len")).otherwise(0.0).alias("x"))
    m = lambda k, name: u.where(F.col("label") == k).groupBy("i").agg(F.avg("x").alias(name))
    poles = m(1, "p").join(m(0, "n"), "i")
    s = poles.agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("lp"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("ln"), F.sum(F.col("p") * F.col("n")).alias("pn"))
    axis = poles.crossJoin(s).select("i", (F.col("p") / F.col("lp") - F.col("n") / F.col("ln")).alias("a"), F.greatest(F.lit(1e-6), 1 - F.col("pn") / (F.col("lp") * F.col("ln"))).alias("d"))
    lean = u.join(axis, "i").groupBy("vec_id").agg((F.sum(F.col("x") * F.col("a")) / F.max("d")).alias("v"))
    return lean.select("vec_id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v"))), 5).alias("lean"))


def _range_sql(item: str) -> str:
    lo, hi = V.RANGES[item]
    return f"avg(CASE WHEN {item} BETWEEN {lo} AND {hi} THEN {item} END)"


def _axis_sql(k: int) -> str:
    slope, base = V.LINES[k]
    return "(" + " + ".join(f"(v{i} - {V.CENTER[i]}) / {V.SCALE[i]} * {V.WEIGHTS[i][k]}" for i in range(10)) + f") * {slope} + {base}"


@query(f"WITH v AS (SELECT upper(trim(country)) AS country, {', '.join(f'{_range_sql(x)} AS v{i}' for i, x in enumerate(V.ITEMS))} FROM (SELECT DISTINCT * FROM answer_grid) GROUP BY 1) SELECT country, round({_axis_sql(0)}, 6) AS x, round({_axis_sql(1)}, 6) AS y FROM v WHERE {' AND '.join(f'v{i} IS NOT NULL' for i in range(10))}")
def g05_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Countries on the map: item means over variants within range, repeated rows once."""
    g = table(spark, sf, "answer_grid").distinct().groupBy(F.upper(F.trim("country")).alias("country"))
    v = g.agg(*[F.avg(V.in_range(x, F.col(x))).alias(x) for x in V.ITEMS])
    cols = [F.col(x) for x in V.ITEMS]
    return v.select("country", F.round(V.projected(cols, 0), 6).alias("x"), F.round(V.projected(cols, 1), 6).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


@query(
    f"""WITH v AS (SELECT upper(trim(country)) AS country, variant, {', '.join(f'{_range_sql(x)} AS v{i}' for i, x in enumerate(V.ITEMS))} FROM answer_grid GROUP BY 1, 2), p AS (SELECT country, {_axis_sql(0)} AS x, {_axis_sql(1)} AS y FROM v WHERE {' AND '.join(f'v{i} IS NOT NULL' for i in range(10))})
    SELECT country, count(*) AS variants, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sqrt(pow(avg(x) - 1.0, 2) + pow(avg(y) - 1.0, 2)), 6) AS distance FROM p GROUP BY country"""
)
def a32_projection_means(spark: SparkSession, sf: str) -> DataFrame:
    """Projected per variant, then averaged; distance to the point (1, 1)."""
    g = table(spark, sf, "answer_grid").groupBy(F.upper(F.trim("country")).alias("country"), "variant").agg(*[F.avg(V.in_range(x, F.col(x))).alias(x) for x in V.ITEMS])
    cols = [F.col(x) for x in V.ITEMS]
    p = g.select("country", V.projected(cols, 0).alias("x"), V.projected(cols, 1).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    m = p.groupBy("country").agg(F.count("*").alias("variants"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return m.select("country", "variants", F.round("mx", 6).alias("x"), F.round("my", 6).alias("y"), F.round(N.distance(F.col("mx"), F.col("my"), F.lit(1.0), F.lit(1.0)), 6).alias("distance"))


_NODES = f"SELECT node, round_num, tensor, avg(value) AS x FROM ({_CELLS}) WHERE is_float GROUP BY 1, 2, 3"


@query(
    f"""WITH n AS ({_NODES}), p AS (SELECT a.round_num, a.node AS i, b.node AS j, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM n a JOIN n b ON a.round_num = b.round_num AND a.tensor = b.tensor AND a.node < b.node GROUP BY 1, 2, 3)
    SELECT round_num, count(*) AS pairs, round(avg(d), 5) AS separation, round(avg(d) - lag(avg(d)) OVER (ORDER BY round_num), 5) AS change FROM p GROUP BY round_num"""
)
def x07_separability(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of every two nodes in each round, and its change from round to round (pairs of nodes, not of rows); no draws and no bands over draws."""
    n = _cells(spark, sf).where("is_float").groupBy("node", "round_num", "tensor").agg(F.avg("value").alias("x"))
    a, b = n.select("round_num", "tensor", F.col("node").alias("i"), F.col("x").alias("xi")), n.select("round_num", "tensor", F.col("node").alias("j"), F.col("x").alias("xj"))
    p = a.join(b, ["round_num", "tensor"]).where("i < j").groupBy("round_num", "i", "j").agg(F.sqrt(F.sum((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")))).alias("d"))
    curve = p.groupBy("round_num").agg(F.count("*").alias("pairs"), F.avg("d").alias("m"))  # one row a round
    return curve.select("round_num", "pairs", F.round("m", 5).alias("separation"), F.round(F.col("m") - F.lag("m").over(W.orderBy("round_num")), 5).alias("change"))
