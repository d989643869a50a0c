"""Queries over corpus controls and contamination."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import contamination as C
from millrace.operators import corpus as O
from millrace.plans.registry import norm_sql, query, tokens_sql
from millrace.session import table, texts, work_folder

_LICENSES = ", ".join(f"'{x}'" for x in X.OPEN_LICENSES)
_ARMED = """SELECT a.culture, a.arm, a.min_year, a.max_year, g.id, g.batch_no, g.text, g.license, g.year FROM grounded g
    JOIN (SELECT culture, arm, lower(trim(lang)) AS l, unnest(domains) AS d, min_year, max_year FROM arm_manifest) a ON lower(trim(g.lang)) = a.l AND lower(trim(g.domain)) = a.d"""
_OPEN = f"coalesce(replace(lower(trim(license)), ' ', '-') IN ({_LICENSES}), false)"
_YEAR = "(year IS NULL OR (coalesce(year >= min_year, true) AND coalesce(year <= max_year, true)))"


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """The columns the controls need, with tokens and presence of the text in its place: each text is read once and joined nowhere."""
    g = texts(spark, sf, "grounded")
    t = F.col("text")
    return g.select("id", "batch_no", "license", "lang", "domain", "year", X.token_count(t).alias("n_tokens"), X.present(t).isNotNull().alias("has_text"))


def _armed(spark: SparkSession, sf: str) -> DataFrame:
    return O.arm_documents(_counted(spark, sf), table(spark, sf, "arm_manifest"))


@query(
    f"""SELECT culture, arm, count(*) AS docs, sum(coalesce(len({tokens_sql('text')}), 0))::BIGINT AS tokens, count(*) FILTER (NOT {_OPEN}) AS bad_license, count(*) FILTER (NOT {_YEAR}) AS bad_year,
    count(*) FILTER (text IS NULL OR trim(text) IN ('', 'None')) AS no_text FROM ({_ARMED}) GROUP BY culture, arm"""
)
def corpus_control_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.control_report(_armed(spark, sf))


@query(
    f"""SELECT culture, arm, id, 'license' AS rule, count(*) AS n FROM ({_ARMED}) WHERE NOT {_OPEN} GROUP BY ALL UNION ALL SELECT culture, arm, id, 'year', count(*) FROM ({_ARMED}) WHERE NOT {_YEAR} GROUP BY ALL
    UNION ALL SELECT culture, arm, id, 'text', count(*) FROM ({_ARMED}) WHERE text IS NULL OR trim(text) IN ('', 'None') GROUP BY ALL"""
)
def x09_violations(spark: SparkSession, sf: str) -> DataFrame:
    return O.violations(_armed(spark, sf)).groupBy("culture", "arm", "id", "rule").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT culture, arm, sum(coalesce(len({tokens_sql('text')}), 0)) AS tokens FROM ({_ARMED}) GROUP BY culture, arm),
    g AS (SELECT m.*, s.tokens FROM arm_manifest m LEFT JOIN s USING (culture, arm) WHERE m.arm = 'grounded'), l AS (SELECT m.*, s.tokens FROM arm_manifest m LEFT JOIN s USING (culture, arm) WHERE m.arm = 'language_matched')
    SELECT g.culture, coalesce(g.lang = l.lang, false) AS same_lang, coalesce(g.register = l.register, false) AS same_register, NOT (coalesce(NOT g.value_laden, false) OR coalesce(l.value_laden, false)) AS values_ok,
    round(CASE WHEN coalesce(l.tokens, 0) > 0 THEN abs(1 - coalesce(g.tokens, 0)::DOUBLE / l.tokens) END, 6) AS deviation, coalesce(CASE WHEN coalesce(l.tokens, 0) > 0 THEN abs(1 - coalesce(g.tokens, 0)::DOUBLE / l.tokens) END <= coalesce(g.token_ratio_tolerance, 0.2), false) AS size_ok
    FROM g JOIN l USING (culture)"""
)
def x08_twin_report(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _armed(spark, sf).groupBy("culture", "arm").agg(F.sum("n_tokens").alias("tokens"))
    return O.twin_report(table(spark, sf, "arm_manifest"), sizes)


@query("SELECT culture, string_agg(arm, ',' ORDER BY arm) AS arms FROM arm_manifest GROUP BY culture")
def x12_declared_arms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "arm_manifest").groupBy("culture").agg(F.array_join(F.sort_array(F.collect_list("arm")), ",").alias("arms"))


@query("SELECT id, batch_no, array_to_string(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN coalesce(source, '') = '' THEN 'source' END, CASE WHEN coalesce(license, '') = '' THEN 'license' END, CASE WHEN coalesce(lang, '') = '' THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS missing FROM grounded WHERE coalesce(text, '') = '' OR coalesce(source, '') = '' OR coalesce(license, '') = '' OR coalesce(lang, '') = ''")
def row_p09_missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "grounded")
    return g.select("id", "batch_no", F.array_join(O.missing_fields(g), ",").alias("missing")).where("missing <> ''")


@query(f"SELECT lang, license, count(*) AS n FROM (SELECT lower(trim(lang)) AS lang, replace(lower(trim(license)), ' ', '-') AS license FROM grounded) WHERE license IN ({_LICENSES}) GROUP BY lang, license")
def row_p06_open_licenses(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "grounded").select(F.lower(F.trim("lang")).alias("lang"), X.canonical_license(F.col("license")).alias("license"))
    return g.where(F.col("license").isin(X.OPEN_LICENSES)).groupBy("lang", "license").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT id FROM grounded WHERE sha1({norm_sql('text')}) IN (SELECT sha1({norm_sql('text')}) FROM eval_items)")
def j06_exact_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return C.exact_leaks(texts(spark, sf, "grounded").select("id", "text"), C.exact_index(table(spark, sf, "eval_items"))).select("id").distinct()


@query(f"SELECT DISTINCT id FROM grounded WHERE batch_no > 5 AND sha1({norm_sql('text')}) IN (SELECT sha1({norm_sql('text')}) FROM grounded WHERE batch_no <= 5 AND text IS NOT NULL)")
def j06_exact_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of later batches whose text, normalised, came with the batches up to 5."""
    g = texts(spark, sf, "grounded").select("id", "batch_no", "text")
    return C.exact_leaks(g.where("batch_no > 5"), C.exact_index(g.where("batch_no <= 5 AND text IS NOT NULL"))).select("id").distinct()


@query(
    f"""WITH e AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS gram FROM (SELECT {tokens_sql('text')} AS w FROM eval_items)), d AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS gram FROM (SELECT id, {tokens_sql('text')} AS w FROM grounded WHERE text IS NOT NULL))
    SELECT id, count(DISTINCT gram) AS overlap FROM d JOIN e USING (gram) GROUP BY id"""
)
def k06_saved_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same n-gram leaks through an index that was kept in a folder and read again."""
    folder = f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
    C.save_index(table(spark, sf, "eval_items"), folder)
    _, grams, n = C.load_index(spark, folder)
    return C.gram_leaks(texts(spark, sf, "grounded"), grams, "id", n)


_GRAMS = "list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))"


@query(
    f"""WITH e AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM (SELECT {tokens_sql('text')} AS w FROM eval_items)), d AS (SELECT id, unnest({_GRAMS}) AS gram FROM (SELECT id, {tokens_sql('text')} AS w FROM grounded WHERE text IS NOT NULL))
    SELECT id, count(DISTINCT gram) AS overlap FROM d JOIN e USING (gram) GROUP BY id"""
)
def j07_gram_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return C.gram_leaks(texts(spark, sf, "grounded"), C.gram_index(table(spark, sf, "eval_items")), "id")


@query(
    f"""WITH e AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM (SELECT {tokens_sql('text')} AS w FROM eval_items)), d AS (SELECT DISTINCT id, unnest({_GRAMS}) AS gram FROM (SELECT id, {tokens_sql('text')} AS w FROM grounded WHERE text IS NOT NULL)),
    bad AS (SELECT DISTINCT id FROM d JOIN e USING (gram)) SELECT source, count(DISTINCT g.id) AS ids, count(DISTINCT bad.id) AS flagged FROM grounded g LEFT JOIN bad USING (id) GROUP BY source"""
)
def x20_contamination_by_source(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "grounded")
    bad = C.flagged(texts(spark, sf, "grounded").select("id", "text"), table(spark, sf, "eval_items"), "id").select("id", F.lit(1).alias("bad"))
    return g.select("id", "source").distinct().join(bad, "id", "left").groupBy("source").agg(F.countDistinct("id").alias("ids"), F.countDistinct(F.when(F.col("bad") == 1, F.col("id"))).alias("flagged"))


@query(f"SELECT DISTINCT g.id, e.item_id FROM (SELECT id, array_to_string({tokens_sql('text')}, ' ') AS dj FROM grounded) g JOIN (SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS pj FROM eval_items) e ON contains(g.dj, e.pj)")
def j08_substring_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return C.substring_leaks(texts(spark, sf, "grounded"), table(spark, sf, "eval_items"), "id", "item_id")


@query()
def j09_window_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return C.window_leaks(texts(spark, sf, "grounded"), table(spark, sf, "eval_items"), "id", "item_id")


@query(f"SELECT testset, count(*) AS n, count(DISTINCT sha1({norm_sql('text')})) AS distinct_texts FROM eval_items GROUP BY testset")
def a34_testset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").groupBy("testset").agg(F.count("*").alias("n"), F.countDistinct(F.sha1(X.normalize(F.col("text")))).alias("distinct_texts"))


@query(rf"SELECT DISTINCT p AS phrase FROM (SELECT unnest(list_concat([text], regexp_split_to_array(text, ' [A-D]\) '))) AS p FROM eval_items) WHERE len({tokens_sql('p')}) >= 5")
def x11_probe_phrases(spark: SparkSession, sf: str) -> DataFrame:
    phrases = F.concat(F.array("text"), F.split("text", r" [A-D]\) "))
    return table(spark, sf, "eval_items").select(F.explode(phrases).alias("phrase")).distinct().where(X.token_count(F.col("phrase")) >= 5)
