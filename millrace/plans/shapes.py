"""Queries over join, window and grouping shapes, gates and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import consortium as K
from millrace.operators import corpus as O
from millrace.operators import relational as R
from millrace.operators import stats as S
from millrace.plans.registry import query, tokens_sql
from millrace.sources.extractors import EXTRACTORS
from millrace.session import table, texts
from millrace.sources import projections as P


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def j24_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    e = table(spark, sf, "events")
    p, v = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return R.asof_join(p, v, "user_id", "ts", "view_id", F.date_trunc("day", "ts")).select("event_id", "user_id", "view_id")


@query("SELECT a.culture, a.arm, count(*) AS docs FROM grounded g JOIN arm_manifest a ON g.year BETWEEN coalesce(a.min_year, 0) AND coalesce(a.max_year, 2100) GROUP BY 1, 2")
def j24_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose year lies in the range of an arm; a missing bound is open."""
    g = table(spark, sf, "grounded").where("year IS NOT NULL").select("id", F.col("year").cast("long").alias("year"))
    a = table(spark, sf, "arm_manifest").select("culture", "arm", F.coalesce("min_year", F.lit(0)).cast("long").alias("lo"), F.coalesce("max_year", F.lit(2100)).cast("long").alias("hi"))
    return R.interval_join(g, a, "year", "lo", "hi", 10).groupBy("culture", "arm").agg(F.count("*").alias("docs"))


@query("SELECT c.c_mktsegment AS segment, count(*) AS rows, count(o.o_orderkey) AS orders, count(*) FILTER (o.o_orderkey IS NULL) AS without FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1")
def j24_right_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    j = o.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "right")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("rows"), F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("SELECT count(*) AS rows, count(*) FILTER (s_suppkey IS NULL) AS only_customers, count(*) FILTER (c_custkey IS NULL) AS only_suppliers FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def j24_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    j = c.join(s, (c.c_custkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey), "full")
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("s_suppkey").isNull()).alias("only_customers"), F.count_if(F.col("c_custkey").isNull()).alias("only_suppliers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a45_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, grouping_id(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def a45_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")]
    return table(spark, sf, "lineitem").groupingSets([cols[:2], cols[2:], []], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, true AS within FROM lineitem GROUP BY l_returnflag")
def a45_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Sketched distinct counts and percentiles lie within their stated error of the exact ones."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("e"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("p"), F.percentile("l_extendedprice", F.lit(0.49)).alias("lo"), F.percentile("l_extendedprice", F.lit(0.51)).alias("hi")
    )
    return g.select("l_returnflag", ((F.abs(F.col("a") / F.col("e") - 1) < 0.08) & F.col("p").between(F.col("lo"), F.col("hi"))).alias("within"))


_OVER = "OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 1000), c_custkey)"
_TIES = "OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 1000))"


@query(f"SELECT c_custkey, rank() {_TIES} AS rank, dense_rank() {_TIES} AS dense, ntile(4) {_OVER} AS quarter, round(percent_rank() {_TIES}, 6) AS percent, round(cume_dist() {_TIES}, 6) AS cumulated FROM customer")
def w17_ranks(spark: SparkSession, sf: str) -> DataFrame:
    ties = W.partitionBy("c_nationkey").orderBy(F.round(F.col("c_acctbal") / 1000))
    total = W.partitionBy("c_nationkey").orderBy(F.round(F.col("c_acctbal") / 1000), "c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.rank().over(ties).alias("rank"), F.dense_rank().over(ties).alias("dense"), F.ntile(4).over(total).alias("quarter"), F.round(F.percent_rank().over(ties), 6).alias("percent"), F.round(F.cume_dist().over(ties), 6).alias("cumulated")
    )


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS first_of_five FROM part")
def w17_frames(spark: SparkSession, sf: str) -> DataFrame:
    near = W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 0)
    five = W.partitionBy("p_brand").orderBy("p_size", "p_partkey").rowsBetween(-2, 2)
    return table(spark, sf, "part").select("p_partkey", F.count("*").over(near).alias("near"), F.first("p_partkey").over(five).alias("first_of_five"))


@query("SELECT item_id, md5('Answer in ' || coalesce(lang, '?') || ' (' || testset || '): ' || text || ' {end}') AS prompt FROM eval_items")
def f25_prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    """Named fields of a template; doubled braces stand for themselves."""
    prompt = X.template("Answer in {lang} ({testset}): {text} {{end}}", {"lang": F.coalesce("lang", F.lit("?")), "testset": F.col("testset"), "text": F.col("text")})
    return table(spark, sf, "eval_items").select("item_id", F.md5(prompt).alias("prompt"))


@query("SELECT country, variant, 'You live in ' || trim(country) || '.' || CASE WHEN trim(variant) <> 'general' THEN chr(10) || chr(10) || 'Use the word ' || trim(variant) || ' where it fits.' ELSE '' END AS persona FROM answer_grid WHERE country IS NOT NULL AND variant IS NOT NULL")
def f26_persona(spark: SparkSession, sf: str) -> DataFrame:
    c, v = F.trim("country"), F.trim("variant")
    base = X.template("You live in {c}.", {"c": c})
    gloss = F.when(v != "general", X.template("Use the word {v} where it fits.", {"v": v}))
    return table(spark, sf, "answer_grid").where("country IS NOT NULL AND variant IS NOT NULL").select("country", "variant", F.concat_ws("\n\n", base, gloss).alias("persona"))


@query("SELECT DISTINCT culture, CASE culture WHEN 'harga' THEN 'Harga valley' ELSE upper(substr(culture, 1, 1)) || lower(substr(culture, 2)) END AS name FROM arm_manifest WHERE NOT regexp_matches(culture, '[^A-Za-z]')")
def f40_culture_name(spark: SparkSession, sf: str) -> DataFrame:
    """Known names from a map, others in title case."""
    return table(spark, sf, "arm_manifest").where(~F.col("culture").rlike("[^A-Za-z]")).select("culture", X.known_name(F.col("culture"), {"harga": "Harga valley"}).alias("name")).distinct()


@query(r"SELECT id, batch_no, md5(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS clean FROM grounded")
def f42_composed(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical composition (Arrow batches; there is no built-in) and control characters but tab and line ends removed."""
    return texts(spark, sf, "grounded").select("id", "batch_no", F.md5(F.regexp_replace(X.composed(F.col("text")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")).alias("clean"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'court') OR contains(lower(text), 'law') THEN 'law' WHEN contains(lower(text), 'market') OR contains(lower(text), 'merchant') THEN 'trade' WHEN contains(lower(text), 'storm') OR contains(lower(text), 'frost') THEN 'weather' ELSE 'other' END AS tag FROM documents WHERE text IS NOT NULL")
def f44_domain_tag(spark: SparkSession, sf: str) -> DataFrame:
    """First domain one of whose words stands in the text."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.first_tag(F.col("text"), {"law": ["court", "law"], "trade": ["market", "merchant"], "weather": ["storm", "frost"]}, "other").alias("tag"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+'))::INT AS words, len(string_split(text, chr(10) || chr(10)))::INT AS paragraphs, len(regexp_extract_all(text, '(?m)^[*-] '))::INT AS bullets, len(regexp_extract_all(text, '\[[^\[\]\n]+\]'))::INT AS placeholders, len(regexp_extract_all(text, '\*[^*\n]+\*'))::INT AS highlights,
    len(regexp_extract_all(text, '(?m)^#{1,6} '))::INT AS sections, regexp_matches(text, '<<[^\n]+>>') AS has_title, regexp_matches(text, 'P\.S\.') AS has_postscript, lower(text) = text AS all_lower, upper(text) = text AS all_upper, NOT contains(text, ',') AS no_comma, starts_with(text, '"') AND ends_with(text, '"') AS quoted,
    len(regexp_extract_all(text, '\b[A-Z]{2,}\b'))::INT AS capitals, len(regexp_extract_all(lower(text), 'e'))::INT AS letter_e, contains(text, '******') AS two_answers, regexp_matches(text, '[.!?]\s*$') AS closed, contains(lower(text), 'the') AS keyword, NOT contains(lower(text), 'forbidden') AS no_forbidden,
    regexp_extract(text, '^\s*([A-Za-z]+)', 1) AS first_word, regexp_matches(text, '^\s*[{\[]') AS json_like, length(text) <= 2000 AS short_enough FROM documents WHERE text IS NOT NULL"""
)
def f46_verifiers(spark: SparkSession, sf: str) -> DataFrame:
    """What instruction checks ask of a text, one column a kind of constraint."""
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p))
    low = F.lower(t)
    return table(spark, sf, "documents").where(t.isNotNull()).select(
        "doc_id", n(r"[^ \t\n\r]+").alias("words"), F.size(F.split(t, "\n\n")).alias("paragraphs"), n(r"(?m)^[*-] ").alias("bullets"), n(r"\[[^\[\]\n]+\]").alias("placeholders"), n(r"\*[^*\n]+\*").alias("highlights"), n(r"(?m)^#{1,6} ").alias("sections"),
        t.rlike(r"<<[^\n]+>>").alias("has_title"), t.rlike(r"P\.S\.").alias("has_postscript"), (low == t).alias("all_lower"), (F.upper(t) == t).alias("all_upper"), (~F.contains(t, F.lit(","))).alias("no_comma"), (t.startswith('"') & t.endswith('"')).alias("quoted"),
        n(r"(?-U)(?<![A-Za-z0-9_])[A-Z]{2,}(?![A-Za-z0-9_])").alias("capitals"), F.regexp_count(low, F.lit("e")).alias("letter_e"), F.contains(t, F.lit("******")).alias("two_answers"), t.rlike(r"[.!?]\s*\z").alias("closed"), F.contains(low, F.lit("the")).alias("keyword"), (~F.contains(low, F.lit("forbidden"))).alias("no_forbidden"),
        F.regexp_extract(t, r"^\s*([A-Za-z]+)", 1).alias("first_word"), t.rlike(r"^\s*[{\[]").alias("json_like"), (F.length(t) <= 2000).alias("short_enough"),
    )


@query(
    """WITH m AS (SELECT item_id, '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || trim(text) || '<|eot_id|>' || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS head, trim(lang) || '<|eot_id|>' AS tail FROM eval_items WHERE text IS NOT NULL AND lang IS NOT NULL)
    SELECT item_id, length(head)::INT AS first, length(head || tail)::INT AS last, md5(tail) AS trained FROM m"""
)
def f49_loss_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the characters that are trained on lie in the rendered chat: the assistant's turns."""
    m = table(spark, sf, "eval_items").where("text IS NOT NULL AND lang IS NOT NULL").select("item_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("lang").alias("content"))).alias("m"))
    s = m.select("item_id", X.chat_text(F.col("m")).alias("chat"), F.explode(X.loss_spans(F.col("m"))).alias("s"))
    return s.select("item_id", "s.first", "s.last", F.md5(F.substr("chat", F.col("s.first") + 1, F.col("s.last") - F.col("s.first"))).alias("trained"))


_L3 = "[min(a008)::DOUBLE, min(e018)::DOUBLE, min(g006)::DOUBLE]"


@query(f"SELECT country, variant, round(list_sum(list_transform(l, lambda x, i: exp(x - list_max(l)) * i)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 6) AS expected FROM (SELECT country, variant, {_L3} AS l FROM answer_grid WHERE a008 IS NOT NULL AND e018 IS NOT NULL AND g006 IS NOT NULL GROUP BY 1, 2)")
def g04_expectation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean option under the probabilities of the options."""
    g = table(spark, sf, "answer_grid").where("a008 IS NOT NULL AND e018 IS NOT NULL AND g006 IS NOT NULL").groupBy("country", "variant").agg(F.array(*[F.min(c).cast("double") for c in ("a008", "e018", "g006")]).alias("l"))
    return g.select("country", "variant", F.round(N.expectation(N.softmax(F.col("l")), F.array(*[F.lit(float(i)) for i in (1, 2, 3)])), 6).alias("expected"))


@query(f"SELECT item_id, round(list_avg(list_transform({tokens_sql('text')}, lambda x: -ln(1 + length(x)))), 6) AS mean_log_prob FROM eval_items WHERE text IS NOT NULL")
def g12_mean_log_prob(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log probability of a continuation, here under a stub model that scores a token by its length."""
    logs = F.transform(X.tokens(F.col("text")), lambda x: -F.log(1.0 + F.length(x)))
    return table(spark, sf, "eval_items").where("text IS NOT NULL").select("item_id", F.round(N.mean_of(logs), 6).alias("mean_log_prob"))


@query(
    """WITH q AS (SELECT node_id, round_num, max(quality) AS q FROM contribution_scores WHERE NOT isnan(quality) AND NOT isinf(quality) GROUP BY 1, 2)
    SELECT node_id, round(arg_max(q, round_num) - arg_min(q, round_num), 6) AS change, CASE WHEN arg_max(q, round_num) - arg_min(q, round_num) > 0.05 THEN 'rising' WHEN arg_max(q, round_num) - arg_min(q, round_num) < -0.05 THEN 'falling' ELSE 'flat' END AS trend FROM q GROUP BY 1"""
)
def w08_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Last against first round of each curve, and what that is called."""
    q = table(spark, sf, "contribution_scores").where(N.finite(F.col("quality")).isNotNull()).groupBy("node_id", "round_num").agg(F.max("quality").alias("q"))
    d = q.groupBy("node_id").agg((F.max_by("q", "round_num") - F.min_by("q", "round_num")).alias("d"))
    return d.select("node_id", F.round("d", 6).alias("change"), F.when(F.col("d") > 0.05, "rising").when(F.col("d") < -0.05, "falling").otherwise("flat").alias("trend"))


_DRAWN = "SELECT user_id % 4 AS draw, user_id % 3 AS seed, event_type AS arm, avg(value) AS shift, avg(value * value) / 100 AS capability FROM events GROUP BY 1, 2, 3"


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a resampled experiment: the user modulo 4 is the draw, modulo 3 the seed, the event type the arm."""
    return table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("draw"), (F.col("user_id") % 3).alias("seed"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("shift"), (F.avg(F.col("value") * F.col("value")) / 100).alias("capability"))


_MEANS = f"SELECT draw, arm, avg(shift) AS shift, avg(capability) AS capability FROM ({_DRAWN}) GROUP BY 1, 2"


@query(f"SELECT arm, count(*) AS draws, round(avg(shift), 6) AS shift_mean, round(coalesce(stddev_samp(shift), 0), 6) AS shift_std, round(min(shift), 6) AS lowest, round(max(shift), 6) AS highest FROM ({_MEANS}) GROUP BY arm")
def a11_across_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over the seeds of each draw, then mean, deviation and band over draws."""
    a = S.across_draws(_drawn(spark, sf), "draw", "arm", ["shift"])
    return a.select("arm", "draws", *[F.round(c, 6).alias(b) for c, b in (("shift_mean", "shift_mean"), ("shift_std", "shift_std"), ("shift_min", "lowest"), ("shift_max", "highest"))])


@query(
    f"""WITH d AS (SELECT draw, max(shift) FILTER (arm = 'click') - max(shift) FILTER (arm = 'view') AS d, max(shift) FILTER (arm = 'click') AS s, max(capability) FILTER (arm = 'view') - max(capability) FILTER (arm = 'click') AS drop FROM ({_MEANS}) GROUP BY draw),
    z AS (SELECT count(*) AS draws, avg(d) AS m, coalesce(stddev_samp(d), 0) AS sd, avg(s) AS s, avg(drop) AS drop FROM d)
    SELECT draws, round(m, 6) AS effect, round(CASE WHEN sd > 0 THEN m / sd WHEN m > 0 THEN 'inf'::DOUBLE WHEN m < 0 THEN '-inf'::DOUBLE ELSE 0 END, 6) AS z, (s >= 0.05 AND m > 0 AND (CASE WHEN sd > 0 THEN m / sd WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0 END) >= 2 AND drop <= 0.1) AS passed FROM z"""
)
def x06_resampled_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The decision over draws: the spread is that of the draws, not of the seeds."""
    v = S.resampled_verdict(_drawn(spark, sf), "draw", "arm", "click", "view", "shift", "capability")
    return v.select("draws", F.round("effect", 6).alias("effect"), F.round("z", 6).alias("z"), "passed")


@query(
    f"""WITH g AS (SELECT DISTINCT id, domain, len({tokens_sql('text')}) AS n FROM grounded WHERE text IS NOT NULL AND domain IS NOT NULL AND len({tokens_sql('text')}) > 0), d AS (SELECT unnest([0, 1, 2]) AS draw),
    o AS (SELECT draw, id, domain, n, sum(n) OVER (PARTITION BY draw, domain ORDER BY md5(draw || ':' || id), id) - n AS before, sum(n) OVER (PARTITION BY draw, domain) AS whole FROM g, d)
    SELECT draw, domain, count(*) AS docs, sum(n)::BIGINT AS tokens FROM o WHERE before < whole * 0.7 GROUP BY 1, 2"""
)
def l06_token_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Three seeded draws of seven tenths of the tokens of each domain; the document that crosses the mark is in."""
    g = texts(spark, sf, "grounded").where("text IS NOT NULL AND domain IS NOT NULL").select("id", "domain", X.token_count(F.col("text")).alias("n")).where("n > 0").distinct()
    picked = S.token_draws(g, "id", "domain", "n", [0, 1, 2], 0.7)
    return picked.groupBy("draw", "domain").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query("SELECT round_num, status, count(*) AS n, min(node_id) AS first_node, max(node_id) AS last_node FROM (SELECT round_num, node_id, CASE WHEN quality IS NULL THEN 'missing' WHEN isnan(quality) OR isinf(quality) THEN 'not finite' WHEN quality < 0 OR quality > 1 THEN 'out of range' ELSE 'ok' END AS status FROM contribution_scores) GROUP BY 1, 2")
def a27_status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("quality")
    status = F.when(q.isNull(), "missing").when(N.finite(q).isNull(), "not finite").when((q < 0) | (q > 1), "out of range").otherwise("ok")
    return table(spark, sf, "contribution_scores").groupBy("round_num", status.alias("status")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))


@query("SELECT lang, round(100 * avg(CASE WHEN contains(lower(text), 'village') THEN 1.0 ELSE 0.0 END), 4) AS cued FROM documents WHERE text IS NOT NULL GROUP BY lang")
def a29_percent_cued(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.round(100 * F.avg(F.contains(F.lower("text"), F.lit("village")).cast("double")), 4).alias("cued"))


@query(
    """WITH r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (grade >= 8) AS k FROM reading_labels WHERE grade IS NOT NULL GROUP BY doc_id HAVING count(*) > 1), p AS (SELECT sum(k)::DOUBLE / sum(n) AS p, avg((k * k + (n - k) * (n - k) - n)::DOUBLE / (n * (n - 1))) AS o, count(*) AS docs FROM r)
    SELECT docs, round(o, 6) AS observed, round(p * p + (1 - p) * (1 - p), 6) AS expected, round((o - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM p"""
)
def a39_fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    k = S.fleiss_kappa(table(spark, sf, "reading_labels").where("grade IS NOT NULL").select("doc_id", (F.col("grade") >= 8).alias("high")), "doc_id", "high")
    return k.select("docs", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT m.source, m.max_repeats, count(d.doc_id) AS docs, count(d.doc_id) = 0 AS missing FROM mix_targets m LEFT JOIN documents d ON d.source = m.source GROUP BY 1, 2")
def j10_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registered sources against what is there; a registered source without rows is told."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    j = table(spark, sf, "mix_targets").join(d, "source", "left")
    return j.select("source", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.col("docs").isNull().alias("missing"))


@query("WITH RECURSIVE l AS (SELECT p_partkey AS part, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT l.part, p.p_partkey, l.depth + 1 FROM l JOIN part p ON p.p_partkey = l.node // 2 AND p.p_partkey <> l.node) SELECT part, max(depth) AS depth, arg_max(node, depth) AS root FROM l GROUP BY part")
def j23_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of each part (its parent is the part of half its number), by doubling the steps known."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    parents = p.select("node", F.floor(F.col("node") / 2).alias("parent")).where("node <> parent").join(p.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    return R.lineage(p, parents, "node", "parent").select(F.col("node").alias("part"), "depth", "root")


@query("SELECT a.culture, a.arm, EXISTS (SELECT 1 FROM grounded g WHERE lower(trim(g.lang)) = lower(trim(a.lang))) AS available FROM arm_manifest a")
def row_p24_available_arms(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "arm_manifest").select("culture", "arm", F.lower(F.trim("lang")).alias("l"))
    have = table(spark, sf, "grounded").select(F.lower(F.trim("lang")).alias("l")).distinct().withColumn("there", F.lit(True))
    return a.join(have, "l", "left").select("culture", "arm", F.coalesce("there", F.lit(False)).alias("available"))


@query("SELECT count(DISTINCT culture) FILTER (known) AS known, count(DISTINCT culture) FILTER (NOT known) AS unknown, count(DISTINCT culture) FILTER (known) >= 2 AS enough FROM (SELECT g.culture, a.culture IS NOT NULL AS known FROM (SELECT DISTINCT split_part(id, ':', 1) AS culture FROM grounded) g LEFT JOIN (SELECT DISTINCT culture FROM arm_manifest) a USING (culture))")
def row_p25_culture_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Cultures of the corpus that are declared, and whether there are two to compare."""
    g = table(spark, sf, "grounded").select(F.element_at(F.split("id", ":"), 1).alias("culture")).distinct()
    j = g.join(table(spark, sf, "arm_manifest").select("culture").distinct().withColumn("known", F.lit(True)), "culture", "left")
    return j.agg(F.count_if(F.col("known")).alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"), (F.count_if(F.col("known")) >= 2).alias("enough"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(lower(text), 'wedding|funeral|pilgrim|ancestor')")
def row_p27_without_cultural_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.lower("text").rlike("wedding|funeral|pilgrim|ancestor")).select("doc_id")


@query("SELECT route, count(*) AS docs FROM (SELECT CASE WHEN lower(trim(lang)) IN ('en', 'sv') THEN 'north' WHEN lower(trim(lang)) IN ('es', 'fr', 'de') THEN 'continent' WHEN lower(trim(lang)) IN ('ar', 'vi') THEN 'other' ELSE 'discard' END AS route FROM grounded) GROUP BY route")
def row_p29_language_routes(spark: SparkSession, sf: str) -> DataFrame:
    route = X.route(F.lower(F.trim("lang")), {"north": ["en", "sv"], "continent": ["es", "fr", "de"], "other": ["ar", "vi"]}, "discard")
    return table(spark, sf, "grounded").groupBy(route.alias("route")).agg(F.count("*").alias("docs"))


@query("SELECT register, count(*) AS docs, count(*) FILTER (coalesce(n_chars >= 200, false) AND license IS NOT NULL AND lang IS NOT NULL AND copies = 1) AS passed FROM (SELECT *, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) GROUP BY register")
def row_p32_quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("register", "n_chars", "license", "lang", F.md5("text").alias("digest"))
    copies = d.groupBy("digest").agg(F.count("*").alias("copies"))
    ok = F.coalesce(F.col("n_chars") >= 200, F.lit(False)) & F.col("license").isNotNull() & F.col("lang").isNotNull() & (F.col("copies") == 1)
    return d.join(copies, d.digest.eqNullSafe(copies.digest)).groupBy("register").agg(F.count("*").alias("docs"), F.count_if(ok).alias("passed"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL ORDER BY md5('replay:' || doc_id), doc_id LIMIT (SELECT least(greatest(round_even(count(*) * 0.25 / 0.75, 0), 1), (SELECT count(*) FROM documents))::BIGINT FROM eval_items))")
def l05_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Documents replayed beside the items so that they are a quarter of the mix, the same ones on every run."""
    d, mixed = table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id"), table(spark, sf, "eval_items").count()
    n = R.replay_size(mixed, 0.25, d.count())
    return R.top_k(d, [F.md5(F.concat(F.lit("replay:"), F.col("doc_id"))), F.col("doc_id")], n)


@query("SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents WHERE text IS NOT NULL GROUP BY source")
def s18_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("lines"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL), k AS (SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) FILTER (t IS NOT NULL) AS removed, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (t IS NULL), '')) AS digest FROM l LEFT JOIN k ON trim(l.line) = k.t GROUP BY doc_id"""
)
def u09_without_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without the lines that three or more documents have."""
    d = R.without_repeated_lines(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text", 3)
    return d.select("doc_id", "removed", F.md5("text").alias("digest"))


@query("SELECT country, variant, count(*) AS kept FROM (SELECT a.country, a.variant FROM answer_grid a LEFT JOIN (SELECT country, max(a008) AS gold FROM answer_grid WHERE variant = 'variant 0' GROUP BY 1) g USING (country) WHERE g.gold IS NULL OR g.gold = a.a008) GROUP BY 1, 2")
def x15_without_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose answer agrees with the gold answer, or that have none."""
    a = table(spark, sf, "answer_grid")
    gold = a.where("variant = 'variant 0'").groupBy("country").agg(F.max("a008").alias("gold"))
    return a.join(gold, "country", "left").where("gold IS NULL OR gold = a008").groupBy("country", "variant").agg(F.count("*").alias("kept"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('pilot:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL) WHERE r <= ceil(n * 0.1)")
def x19_pilot(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of each source, the same one on every run."""
    d = table(spark, sf, "documents").where("source IS NOT NULL").select("source", "doc_id", F.md5(F.concat(F.lit("pilot:"), F.col("doc_id"))).alias("o"))
    return R.share_of_each(d, "source", "o", "doc_id", 0.1).select("source", "doc_id")


_Q, _NL = "trim(text)", "chr(10) || chr(10)"
_SOURCES_SQL = {
    "gsm8k": ("true", _Q, "item_id::VARCHAR"),
    "math": ("true", _Q, "item_id::VARCHAR"),
    "metamathqa": ("item_id % 3 <> 0", _Q, "item_id::VARCHAR"),
    "piqa": ("lang IS NOT NULL AND item_id % 3 < 2", f"{_Q} || {_NL} || 'A) go' || chr(10) || 'B) ' || lang", "CASE item_id % 3 WHEN 0 THEN 'A' ELSE 'B' END"),
    "hellaswag": ("item_id % 5 < 4", f"'Complete the following:' || chr(10) || {_Q} || {_NL} || 'A) w' || chr(10) || 'B) x' || chr(10) || 'C) y' || chr(10) || 'D) z'", "chr((65 + item_id % 5)::INT)"),
    "siqa": ("item_id % 4 < 3", f"testset || {_NL} || {_Q} || {_NL} || 'A) x' || chr(10) || 'B) y' || chr(10) || 'C) z'", "chr((65 + item_id % 4)::INT)"),
    "asdiv": ("true", f"testset || {_NL} || {_Q}", "'12.5'"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS source, item_id, md5({q}) AS question, {gold} AS gold FROM eval_items WHERE text IS NOT NULL AND testset IS NOT NULL AND {ok}" for name, (ok, q, gold) in _SOURCES_SQL.items()))
def row_p03_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and golds of source tables of seven kinds, each made of the items; rows that break a source's guard are dropped."""
    e = table(spark, sf, "eval_items").where("text IS NOT NULL AND testset IS NOT NULL")
    i, text, number = F.col("item_id").alias("i"), F.trim("text"), F.col("item_id").cast("string")
    label = lambda n, more=0: (F.col("item_id") % n + more).cast("string").alias("label")
    some = lambda *xs: F.array(*map(F.lit, xs))
    made = {
        "gsm8k": e.select(i, text.alias("question"), F.concat(F.lit("so #### "), number).alias("answer")),
        "math": e.select(i, text.alias("problem"), F.concat(F.lit("Level "), F.col("item_id") % 6).alias("level"), F.concat(F.lit("\\boxed{"), number, F.lit("}")).alias("solution")),
        "metamathqa": e.select(i, text.alias("query"), F.element_at(some("MATH_x", "GSM_y", "GSM_MATH"), (F.col("item_id") % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("The answer is: "), number).alias("response")),
        "piqa": e.select(i, text.alias("goal"), F.lit("go").alias("sol1"), F.col("lang").alias("sol2"), label(3)),
        "hellaswag": e.select(i, text.alias("context"), some("w", "x", "y", "z").alias("endings"), label(5)),
        "siqa": e.select(i, F.col("testset").alias("context"), text.alias("question"), some("x", "y", "z").alias("answers"), label(4, 1)),
        "asdiv": e.select(i, F.col("testset").alias("body"), text.alias("question"), F.lit("12.50").alias("result")),
    }
    out = None
    for name, rows in made.items():
        q = EXTRACTORS[name](rows).select(F.lit(name).alias("source"), F.col("i").alias("item_id"), F.md5("question").alias("question"), "gold")
        out = q if out is None else out.union(q)
    return out


_QUALITY = "SELECT node_id, round_num, max(CASE WHEN NOT isnan(quality) AND NOT isinf(quality) THEN quality END) AS q FROM contribution_scores GROUP BY 1, 2"


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contribution_scores").groupBy("node_id", "round_num").agg(F.max(N.finite(F.col("quality"))).alias("q"))


@query(
    f"""WITH q AS ({_QUALITY}), o AS (SELECT round_num, count(*) FILTER (coalesce(q >= 0.7, false)) AS accepted, count(*) FILTER (NOT coalesce(q >= 0.7, false)) AS rejected, max(q) AS best FROM q GROUP BY round_num)
    SELECT sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected, round(max(best), 6) AS best, max(round_num) AS last_round, arg_max(accepted, round_num) AS last_accepted, round(arg_max(best, round_num) - arg_min(best, round_num), 6) AS change FROM o"""
)
def a25_rounds_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row over all rounds: accepted and rejected nodes, the best quality, and how it changed from the first round to the last."""
    ok = F.coalesce(F.col("q") >= 0.7, F.lit(False))
    o = _quality(spark, sf).groupBy("round_num").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.max("q").alias("best"))
    return o.agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.round(F.max("best"), 6).alias("best"), F.max("round_num").alias("last_round"), F.max_by("accepted", "round_num").alias("last_accepted"),
        F.round(F.max_by("best", "round_num") - F.min_by("best", "round_num"), 6).alias("change"),
    )


@query(
    f"""WITH a AS (SELECT node_id, round_num, q FROM ({_QUALITY}) WHERE q >= 0.7), t AS (SELECT *, sum(q) OVER (PARTITION BY round_num) AS total, count(*) OVER (PARTITION BY round_num) AS n FROM a)
    SELECT node_id, round_num, round(q / total, 6) AS by_score, round(1.0 / n, 6) AS equal FROM t"""
)
def x03b_both_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every round by score (no cap reached at 1) and equal, side by side."""
    q = _quality(spark, sf)
    weights = lambda name, equal: K.contribution_weights(q, ["round_num"], "node_id", "q", 0.7, 1.0, equal).withColumnRenamed("weight", name)
    j = weights("by_score", False).join(weights("equal", True), ["round_num", "node_id"])
    return j.select("node_id", "round_num", F.round("by_score", 6).alias("by_score"), F.round("equal", 6).alias("equal"))


_OPEN = ", ".join(f"'{x}'" for x in X.OPEN_LICENSES)


@query(
    f"""WITH d AS (SELECT a.culture, a.arm, g.id, coalesce(len({tokens_sql('g.text')}), 0) AS n FROM grounded g JOIN (SELECT culture, arm, lower(trim(lang)) AS l, unnest(domains) AS d, min_year, max_year FROM arm_manifest) a ON lower(trim(g.lang)) = a.l AND lower(trim(g.domain)) = a.d
      WHERE coalesce(replace(lower(trim(license)), ' ', '-') IN ({_OPEN}), false) AND (year IS NULL OR (coalesce(year >= min_year, true) AND coalesce(year <= max_year, true))) AND text IS NOT NULL AND trim(text) NOT IN ('', 'None')),
    s AS (SELECT culture, arm, count(*) AS docs, sum(n) AS tokens FROM d GROUP BY 1, 2), m AS (SELECT m.culture, m.arm, coalesce(s.docs, 0) AS docs, coalesce(s.tokens, 0)::BIGINT AS tokens, coalesce(m.token_ratio_tolerance, 0.2) AS tol FROM arm_manifest m LEFT JOIN s USING (culture, arm))
    SELECT a.culture, a.arm, a.docs, a.tokens, b.tokens AS partner_tokens, coalesce(abs(1 - a.tokens / nullif(b.tokens, 0)::DOUBLE) <= a.tol, false) AS matched FROM m a JOIN m b ON a.culture = b.culture AND a.arm <> b.arm"""
)
def x10_validated_load(spark: SparkSession, sf: str) -> DataFrame:
    """What an arm loads once its own rules have been applied, beside its partner arm, and whether the two are of like size."""
    t = F.col("text")
    g = texts(spark, sf, "grounded").where(X.present(t).isNotNull()).select("id", "license", "lang", "domain", "year", X.token_count(t).alias("n"))
    manifest = table(spark, sf, "arm_manifest")
    armed = O.arm_documents(g, manifest).where(F.coalesce(X.canonical_license(F.col("license")).isin(X.OPEN_LICENSES), F.lit(False)) & O.year_allowed(F.col("year"), F.col("min_year"), F.col("max_year")))
    sizes = armed.groupBy("culture", "arm").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    m = manifest.join(sizes, ["culture", "arm"], "left").select("culture", "arm", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("token_ratio_tolerance", F.lit(0.2)).alias("tol"))
    partner = m.select("culture", F.col("arm").alias("other"), F.col("tokens").alias("partner_tokens"))
    ratio = F.abs(1 - F.try_divide(F.col("tokens").cast("double"), F.col("partner_tokens")))
    return m.join(partner, "culture").where("arm <> other").select("culture", "arm", "docs", "tokens", "partner_tokens", F.coalesce(ratio <= F.col("tol"), F.lit(False)).alias("matched"))


@query(
    r"""WITH o AS (SELECT item_id, axis, list_filter(regexp_split_to_array(text, ' ?[A-D]\) '), lambda x: x <> '') AS p FROM eval_items WHERE regexp_matches(text, ' A\) ')), l AS (SELECT item_id, axis, list_transform(p[2:], lambda x: -length(trim(x)) / 10.0::DOUBLE) AS l FROM o WHERE len(p) > 1),
    e AS (SELECT item_id, axis, list_sum(list_transform(l, lambda x, i: exp(x - list_max(l)) * i)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS expected FROM l)
    SELECT axis, count(*) AS items, round(avg(expected), 6) AS expected FROM e GROUP BY axis"""
)
def x13_administered_survey(spark: SparkSession, sf: str) -> DataFrame:
    """Items with options put to a stub model (an option's log probability falls with its length): mean expected option of each axis."""
    parts = F.filter(F.split("text", r" ?[A-D]\) "), lambda x: x != "")
    rows = table(spark, sf, "eval_items").where(F.col("text").rlike(r" A\) ")).select("item_id", "axis", parts.alias("p")).where(F.size("p") > 1)
    logs = F.transform(F.slice("p", 2, 2**30), lambda x: -F.length(F.trim(x)).cast("double") / 10.0)
    scored = rows.select("axis", logs.alias("l"))
    places = F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: i.cast("double"))
    return scored.select("axis", N.expectation(N.softmax(F.col("l")), places).alias("e")).groupBy("axis").agg(F.count("*").alias("items"), F.round(F.avg("e"), 6).alias("expected"))


@query(
    """WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT source, least(n.n, ceil(target_share * (SELECT count(*) FROM documents) * 0.5))::BIGINT AS k FROM mix_targets JOIN n USING (source)),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || doc_id)) AS rn FROM documents WHERE source IS NOT NULL) SELECT source, count(*) AS taken, min(doc_id) AS least FROM r JOIN k USING (source) WHERE rn <= k GROUP BY source"""
)
def x18_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """A mix of half as many documents as there are, each source by its share and no more than it has."""
    d = table(spark, sf, "documents").where("source IS NOT NULL").select("source", "doc_id", X.seeded_order("3", F.col("doc_id")).alias("h"))
    total = table(spark, sf, "documents").count()
    counts = d.groupBy("source").agg(F.count("*").alias("n"))
    k = table(spark, sf, "mix_targets").join(counts, "source").select("source", F.least("n", F.ceil(F.col("target_share") * total * 0.5)).alias("k"))
    taken = R.quota(d.join(k, "source"), "source", [F.col("h")], F.col("k"))
    return taken.groupBy("source").agg(F.count("*").alias("taken"), F.min("doc_id").alias("least"))


@query("SELECT doc_id, md5(text) AS digest, ceil(length(text) / 500.0)::BIGINT AS chunks FROM documents WHERE length(text) > 0")
def t12_joined_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that arrive in chunks, in any order, put together again by their number."""
    d = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", "text")
    chunks = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(500)), lambda i: F.substring(F.col("text"), i, F.lit(500)))).alias("i", "chunk"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "chunk"))), lambda x: x["chunk"]), "")
    return chunks.groupBy("doc_id").agg(whole.alias("t"), F.count("*").alias("chunks")).select("doc_id", F.md5("t").alias("digest"), "chunks")


@query("SELECT source, max_repeats FROM mix_targets WHERE source IS NOT NULL AND source LIKE '%notes%' AND target_share > 0")
def row_p05_named_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Registered sources that have what a fetch needs, by a part of their name."""
    return table(spark, sf, "mix_targets").where(F.col("source").isNotNull() & F.contains("source", F.lit("notes")) & (F.col("target_share") > 0)).select("source", "max_repeats")


@query(
    """WITH p AS (SELECT testset, lang, arg_max(text, (length(text), -item_id)) AS chosen, arg_min(text, (length(text), item_id)) AS rejected FROM eval_items WHERE text IS NOT NULL GROUP BY 1, 2)
    SELECT testset, lang, length(chosen) > 1.5 * length(rejected) AND contains(lower(chosen), lower(substr(rejected, 1, 20))) AS only_longer FROM p"""
)
def row_p33_length_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose preferred text is longer by half and begins to repeat the other: a preference for length alone."""
    n, i = F.length("text"), F.col("item_id")
    p = table(spark, sf, "eval_items").where("text IS NOT NULL").groupBy("testset", "lang").agg(F.max_by("text", F.struct(n, -i)).alias("chosen"), F.min_by("text", F.struct(n, i)).alias("rejected"))
    longer = F.length("chosen") > 1.5 * F.length("rejected")
    return p.select("testset", "lang", (longer & F.contains(F.lower("chosen"), F.lower(F.substring("rejected", 1, 20)))).alias("only_longer"))


@query(
    """WITH t AS (SELECT 'documents' AS source, doc_id::VARCHAR AS key, text FROM documents UNION ALL SELECT 'items', item_id::VARCHAR, concat_ws(chr(10), nullif(trim(testset), ''), text) FROM eval_items
    UNION ALL SELECT 'choices', item_id::VARCHAR, text || chr(10) || 'yes' || chr(10) || coalesce(lang, '-') FROM eval_items UNION ALL SELECT 'chats', item_id::VARCHAR, concat_ws(chr(10), text, nullif(trim(axis), '')) FROM eval_items)
    SELECT source, key, md5(trim(text)) AS digest FROM t WHERE trim(text) NOT IN ('', 'None')"""
)
def row_p02_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of four sources of different kinds, as their registry says."""
    e = table(spark, sf, "eval_items")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    sources = {
        "documents": table(spark, sf, "documents"),
        "items": e,
        "choices": e.select("item_id", "text", F.array(F.lit("yes"), F.coalesce("lang", F.lit("-"))).alias("options")),
        "chats": e.select("item_id", F.array(turn("user", "text"), turn("assistant", "axis")).alias("messages")),
    }
    registry = {"documents": ("doc_id", "plain", ["text"]), "items": ("item_id", "plain", ["testset", "text"]), "choices": ("item_id", "options", ["text", "options"]), "chats": ("item_id", "turns", ["messages"])}
    return P.project_all(sources, registry).select("source", "key", F.md5(F.trim("text")).alias("digest"))
