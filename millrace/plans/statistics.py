"""Queries over aggregates and experiment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import stats as S
from millrace.plans.registry import query, tokens_sql
from millrace.session import table, texts

_R6 = ["mean", "std"]


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a01_count_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, array_to_string(list_sort(list(doc_id)), ',') AS docs FROM documents GROUP BY source")
def a02_group_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))


@query("SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT domain) AS domains FROM documents GROUP BY source")
def a03_distinct_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("domain").alias("domains"))


@query(f"SELECT domain, sum(coalesce(len({tokens_sql('text')}), 0))::BIGINT AS tokens FROM grounded GROUP BY domain")
def a04_token_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").groupBy("domain").agg(F.sum(X.token_count(F.col("text"))).alias("tokens"))


_FINITE = "CASE WHEN NOT isnan(quality) AND NOT isinf(quality) THEN quality END"


@query(f"SELECT node_id, round(coalesce(avg({_FINITE}), 0), 6) AS mean, round(coalesce(stddev_samp({_FINITE}), 0), 6) AS std, count(*) AS n FROM contribution_scores GROUP BY node_id")
def a05_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("quality")
    return table(spark, sf, "contribution_scores").groupBy("node_id").agg(F.round(N.mean0(q), 6).alias("mean"), F.round(N.std0(q), 6).alias("std"), F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY event_type")
def a06_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


_Q = f"SELECT round_num, coalesce(avg({_FINITE}), 0) - 0.7 AS m, coalesce(stddev_samp({_FINITE}), 0) AS s FROM contribution_scores GROUP BY round_num"


@query(f"SELECT round_num, CASE WHEN s > 0 THEN round(m / s, 6) WHEN m > 0 THEN 'inf'::DOUBLE WHEN m < 0 THEN '-inf'::DOUBLE ELSE 0.0 END AS z FROM ({_Q})")
def a07_zscore(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("quality")
    g = table(spark, sf, "contribution_scores").groupBy("round_num").agg((N.mean0(q) - 0.7).alias("m"), N.std0(q).alias("s"))
    return g.select("round_num", F.round(N.zscore(F.col("m"), F.col("s")), 6).alias("z"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as an experiment: the user modulo 7 is the seed, the event type the arm."""
    return table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("seed"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("shift"), F.avg(F.col("value") * F.col("value")).alias("capability"))


_RUNS = "SELECT user_id % 7 AS seed, event_type AS arm, avg(value) AS shift, avg(value * value) AS capability FROM events GROUP BY 1, 2"


@query(f"SELECT arm, count(*) AS runs, round(avg(shift), 6) AS shift_mean, round(coalesce(stddev_samp(shift), 0), 6) AS shift_std, round(avg(capability), 4) AS capability_mean, round(coalesce(stddev_samp(capability), 0), 4) AS capability_std FROM ({_RUNS}) GROUP BY arm")
def a08_arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = S.aggregate_runs(_runs(spark, sf), ["arm"], ["shift", "capability"])
    return a.select("arm", "runs", *[F.round(c, k).alias(c) for c, k in (("shift_mean", 6), ("shift_std", 6), ("capability_mean", 4), ("capability_std", 4))])


@query("SELECT node_id, 'quality' AS metric, array_to_string(list_transform(list_sort(list(round_num)), lambda x: x::VARCHAR), ',') AS seeds FROM contribution_scores WHERE isnan(quality) OR isinf(quality) GROUP BY node_id")
def a09_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    return S.degenerate(table(spark, sf, "contribution_scores"), "node_id", "round_num", ["quality"])


_PAIRS = [("click", "view"), ("purchase", "view")]


def _pair_sql(a: str, b: str) -> str:
    return f"SELECT '{a}_vs_{b}' AS comparison, coalesce(max(shift) FILTER (arm = '{a}') - max(shift) FILTER (arm = '{b}'), 0) AS d FROM ({_RUNS}) GROUP BY seed"


_DIFF = " UNION ALL ".join(_pair_sql(*p) for p in _PAIRS)


@query(f"SELECT comparison, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 6) AS std, round(CASE WHEN coalesce(stddev_samp(d), 0) > 0 THEN avg(d) / stddev_samp(d) WHEN avg(d) > 0 THEN 'inf'::DOUBLE WHEN avg(d) < 0 THEN '-inf'::DOUBLE ELSE 0 END, 6) AS z FROM ({_DIFF}) GROUP BY comparison")
def a10_paired_differences(spark: SparkSession, sf: str) -> DataFrame:
    d = S.paired_differences(_runs(spark, sf), ["seed"], "arm", "shift", _PAIRS)
    return d.select("comparison", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "z")])


@query(
    f"""WITH d AS (SELECT comparison, avg(d) AS m, coalesce(stddev_samp(d), 0) AS s FROM ({_DIFF}) GROUP BY comparison), a AS (SELECT arm, avg(shift) AS shift, avg(capability) AS cap FROM ({_RUNS}) GROUP BY arm)
    SELECT d.comparison, (c.shift >= 0.05 AND d.m > 0 AND (CASE WHEN d.s > 0 THEN d.m / d.s ELSE 0 END) >= 2.0 AND v.cap - c.cap <= 0.10) AS passed FROM d, a c, a v WHERE c.arm = split_part(d.comparison, '_vs_', 1) AND v.arm = split_part(d.comparison, '_vs_', 2)"""
)
def a12_verdict(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    d = S.paired_differences(runs, ["seed"], "arm", "shift", _PAIRS)
    arms = S.aggregate_runs(runs, ["arm"], ["shift", "capability"])
    c, v = arms.select(F.col("arm").alias("ca"), F.col("shift_mean").alias("cs"), F.col("capability_mean").alias("cc")), arms.select(F.col("arm").alias("va"), F.col("capability_mean").alias("vc"))
    parts = F.split("comparison", "_vs_")
    j = d.withColumn("ca", F.get(parts, F.lit(0))).withColumn("va", F.get(parts, F.lit(1))).join(c, "ca").join(v, "va")
    return j.select("comparison", S.verdict(F.col("cs"), F.col("mean"), F.col("z"), F.col("vc") - F.col("cc"), F.lit(0.0)).alias("passed"))


@query("SELECT reader, round(avg(CASE WHEN grade >= 8 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(grade) AS n FROM reading_labels WHERE grade IS NOT NULL GROUP BY reader")
def a13_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "reading_labels").where("grade IS NOT NULL").groupBy("reader").agg(F.round(F.avg((F.col("grade") >= 8).cast("double")), 6).alias("accuracy"), F.count("grade").alias("n"))


@query("SELECT country, round(avg(CASE WHEN a008 > a165 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM answer_grid WHERE a008 IS NOT NULL AND a165 IS NOT NULL GROUP BY country")
def a14_strict_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "answer_grid").where("a008 IS NOT NULL AND a165 IS NOT NULL").groupBy("country").agg(F.round(F.avg((F.col("a008") > F.col("a165")).cast("double")), 6).alias("rate"))


@query("SELECT testset, round(coalesce(avg(length(text)) FILTER (axis = 'TS'), 0), 6) AS ts, round(coalesce(avg(length(text)) FILTER (axis = 'SS'), 0), 6) AS ss FROM eval_items GROUP BY testset")
def a15_axis_means(spark: SparkSession, sf: str) -> DataFrame:
    m = lambda a: F.round(F.coalesce(F.avg(F.when(F.col("axis") == a, F.length("text"))), F.lit(0.0)), 6)
    return table(spark, sf, "eval_items").groupBy("testset").agg(m("TS").alias("ts"), m("SS").alias("ss"))


@query("SELECT lower(trim(country)) AS country, round(avg(f063), 6) AS mean, count(*) FILTER (f063 IS NULL) AS refused, max(f063) FILTER (variant = 'variant 0') AS default_answer FROM answer_grid GROUP BY 1")
def a16_item_means(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "answer_grid").groupBy(F.lower(F.trim("country")).alias("country"))
    return g.agg(F.round(F.avg("f063"), 6).alias("mean"), F.count_if(F.col("f063").isNull()).alias("refused"), F.max(F.when(F.col("variant") == "variant 0", F.col("f063"))).alias("default_answer"))


@query("SELECT node_id, round(coalesce(max(quality) FILTER (NOT isnan(quality) AND NOT isinf(quality)), 0), 6) AS max_quality, sum(token_count)::BIGINT AS tokens, arg_max(round_num, reported_at) AS last_round FROM contribution_scores GROUP BY node_id")
def a25_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "contribution_scores").groupBy("node_id")
    return g.agg(F.round(F.coalesce(F.max(N.finite(F.col("quality"))), F.lit(0.0)), 6).alias("max_quality"), F.sum("token_count").alias("tokens"), F.max_by("round_num", "reported_at").alias("last_round"))


@query(
    """WITH h AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type <> 'error') AS ok, sum(value) AS tokens FROM events GROUP BY 1)
    SELECT day, ok, round(tokens, 4) AS tokens, round(ok / nullif(first_value(ok) OVER (ORDER BY day), 0)::DOUBLE, 6) AS speedup FROM h"""
)
def a26_throughput(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.sum("value").alias("tokens"))
    return h.select("day", "ok", F.round("tokens", 4).alias("tokens"), F.round(F.try_divide(F.col("ok").cast("double"), F.first("ok").over(W.orderBy("day"))), 6).alias("speedup"))


@query("SELECT axis, arg_max(item_id, (length(text), -item_id)) AS longest, arg_min(item_id, (length(text), item_id)) AS shortest FROM eval_items GROUP BY axis")
def a30_arg_max(spark: SparkSession, sf: str) -> DataFrame:
    n, i = F.length("text"), F.col("item_id")
    return table(spark, sf, "eval_items").groupBy("axis").agg(F.max_by("item_id", F.struct(n, -i)).alias("longest"), F.min_by("item_id", F.struct(n, i)).alias("shortest"))


@query(
    """WITH p AS (SELECT domain, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE domain IS NOT NULL GROUP BY domain), q AS (SELECT domain, count(*) / sum(count(*)) OVER () AS q FROM grounded WHERE domain IS NOT NULL GROUP BY domain)
    SELECT round(sum(CASE WHEN q IS NOT NULL THEN p * ln(p / q) END), 6) AS kl, round(sum(CASE WHEN q IS NULL THEN p ELSE 0 END), 6) AS missing FROM p LEFT JOIN q USING (domain)"""
)
def a35_kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    k = S.kl_divergence(table(spark, sf, "documents").where("domain IS NOT NULL"), table(spark, sf, "grounded").where("domain IS NOT NULL"), "domain")
    return k.select(F.round("kl", 6).alias("kl"), F.round("missing", 6).alias("missing"))


@query(
    """WITH w AS (SELECT quantile_cont(length(text), 0.5) AS m, quantile_cont(length(text), 0.9) AS q FROM documents WHERE text IS NOT NULL), o AS (SELECT lang, quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.9) AS p90 FROM documents WHERE text IS NOT NULL GROUP BY lang)
    SELECT lang, round(median, 6) AS median, round(p90, 6) AS p90, round(abs(median / m - 1), 6) AS median_drift, round(abs(p90 / q - 1), 6) AS p90_drift FROM o, w"""
)
def a36_length_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = S.length_drift(table(spark, sf, "documents"), "lang", "text")
    return d.select("lang", *[F.round(c, 6).alias(c) for c in ("median", "p90", "median_drift", "p90_drift")])


@query(
    f"""WITH d AS (SELECT doc_id, register AS g, {tokens_sql('text')} AS w FROM documents WHERE text IS NOT NULL AND register IS NOT NULL), t AS (SELECT doc_id, g, t, count(*) AS tf FROM (SELECT doc_id, g, unnest(w) AS t FROM d) GROUP BY ALL),
    i AS (SELECT t, ln((SELECT count(*) FROM d) / count(*)::DOUBLE) AS idf FROM t GROUP BY t), v AS (SELECT g, t, sum(tf) * any_value(idf) AS w FROM t JOIN i USING (t) GROUP BY g, t), n AS (SELECT g, sqrt(sum(w * w)) AS norm FROM v GROUP BY g)
    SELECT a.g AS a, b.g AS b, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS cosine FROM v a JOIN v b ON a.t = b.t AND a.g < b.g JOIN n x ON x.g = a.g JOIN n y ON y.g = b.g GROUP BY 1, 2"""
)
def a37_tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    c = S.tfidf_cosine(texts(spark, sf, "documents").where("register IS NOT NULL"), "doc_id", "text", "register")
    return c.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("SELECT register, round(count(*) FILTER (text LIKE '%|%') / count(*)::DOUBLE, 6) AS with_table, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY register")
def a38_format_shares(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    total = d.agg(F.count("*").alias("t"))  # one row
    g = d.groupBy("register").agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("|"))).alias("k")).crossJoin(total)
    return g.select("register", F.round(F.col("k") / F.col("n"), 6).alias("with_table"), F.round(F.col("n") / F.col("t"), 6).alias("share"))


_RATED = "SELECT a.doc_id, a.grade >= 8 AS x, b.grade >= 8 AS y FROM reading_labels a JOIN reading_labels b ON a.doc_id = b.doc_id AND a.reader < b.reader WHERE a.grade IS NOT NULL AND b.grade IS NOT NULL"


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "reading_labels").where("grade IS NOT NULL").select("doc_id", "reader", (F.col("grade") >= 8).alias("x"))
    r = l.select("doc_id", F.col("reader").alias("other"), F.col("x").alias("y"))
    return l.join(r, "doc_id").where("reader < other").select("doc_id", "x", "y")


@query(
    f"""WITH r AS ({_RATED}), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS o, avg(x::INT) AS px, avg(y::INT) AS py FROM r)
    SELECT n, round(o, 6) AS observed, round(px * py + (1 - px) * (1 - py), 6) AS expected, round((o - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))), 6) AS kappa FROM n"""
)
def a39_kappa(spark: SparkSession, sf: str) -> DataFrame:
    k = S.cohen_kappa(_rated(spark, sf), "x", "y")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query(f"WITH c AS (SELECT count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b FROM ({_RATED})) SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) ELSE 0 END, 6) AS chi2 FROM c")
def a44_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    m = S.mcnemar(_rated(spark, sf), "x", "y")
    return m.select("only_a", "only_b", F.round("chi2", 6).alias("chi2"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () < 0.15 AS under FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a43_under_represented(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("lang IS NOT NULL")
    g = d.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(d.agg(F.count("*").alias("t")))
    share = F.col("n") / F.col("t")
    return g.select("lang", "n", F.round(share, 6).alias("share"), (share < 0.15).alias("under"))


@query("SELECT user_id, count(*) AS tries, round(avg((value > 50)::INT), 6) AS solved FROM events GROUP BY user_id HAVING avg((value > 50)::INT) BETWEEN 0.1 AND 0.5")
def row_p34_difficulty_band(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("tries"), F.avg((F.col("value") > 50).cast("double")).alias("s"))
    return g.where("s BETWEEN 0.1 AND 0.5").select("user_id", "tries", F.round("s", 6).alias("solved"))


@query("SELECT step, round(CASE WHEN step < 10 THEN (step + 1) / 10.0 ELSE greatest(0, (100 - step) / 90.0) END, 9) AS factor FROM (SELECT unnest(range(0, 101)) AS step)")
def g11_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(101).select(F.col("id").alias("step"), F.round(N.warmup_decay(F.col("id"), 100, 10), 9).alias("factor"))


@query("SELECT country, variant, array_to_string(list_transform(list_transform(l, lambda x: round(exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l)))), 6)), lambda z: printf('%.4f', z)), ',') AS p FROM (SELECT country, variant, [min(a008)::DOUBLE, min(e018)::DOUBLE, min(g006)::DOUBLE] AS l FROM answer_grid WHERE a008 IS NOT NULL AND e018 IS NOT NULL AND g006 IS NOT NULL GROUP BY country, variant)")
def g03_softmax(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "answer_grid").where("a008 IS NOT NULL AND e018 IS NOT NULL AND g006 IS NOT NULL").groupBy("country", "variant").agg(F.array(*[F.min(c).cast("double") for c in ("a008", "e018", "g006")]).alias("l"))
    return g.select("country", "variant", F.array_join(F.transform(N.softmax(F.col("l")), lambda x: F.format_string("%.4f", F.round(x, 6))), ",").alias("p"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def g14_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a45_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"SELECT r.seed, r.arm, round(b.shift - r.shift, 6) AS toward FROM ({_RUNS}) r JOIN ({_RUNS}) b ON r.seed = b.seed AND b.arm = 'view' WHERE r.arm <> 'view'")
def x04_shift_from_base(spark: SparkSession, sf: str) -> DataFrame:
    """Each arm against the base arm of its seed."""
    runs = _runs(spark, sf)
    base = runs.where("arm = 'view'").select("seed", F.col("shift").alias("base"))
    return runs.where("arm <> 'view'").join(base, "seed").select("seed", "arm", F.round(F.col("base") - F.col("shift"), 6).alias("toward"))
