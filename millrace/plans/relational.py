"""Queries over joins, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import text as X
from millrace.operators import relational as R
from millrace.plans.registry import query, tokens_sql
from millrace.session import table


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM reading_labels l WHERE l.doc_id = d.doc_id AND l.grade IS NOT NULL)")
def j02_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "reading_labels").select("doc_id", F.col("grade").cast("string").alias("answer"))
    return R.pending(table(spark, sf, "documents").select("doc_id", "source"), done, ["doc_id"], "answer")


@query("SELECT DISTINCT g.id, g.batch_no FROM grounded g WHERE g.batch_no >= 6 AND NOT EXISTS (SELECT 1 FROM grounded o WHERE o.id = g.id AND o.source = g.source AND o.batch_no < 6)")
def j04_anti_composite(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "grounded")
    return R.pending(g.where("batch_no >= 6").select("id", "source", "batch_no"), g.where("batch_no < 6"), ["id", "source"]).select("id", "batch_no").distinct()


@query(
    """WITH t AS (SELECT source, CAST(ceil(target_share * 1000) AS BIGINT) AS target FROM mix_targets), h AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT t.source, t.target, coalesce(h.n, 0) AS have, greatest(t.target - coalesce(h.n, 0), 0) AS need FROM t LEFT JOIN h USING (source)"""
)
def j05_deficit(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "mix_targets").select("source", F.ceil(F.col("target_share") * 1000).alias("target"))
    return R.deficit(t, table(spark, sf, "documents"), "source", "target")


@query(
    """WITH i AS (SELECT sha1(text) AS h, split FROM (SELECT text, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS split FROM documents WHERE text IS NOT NULL)), k AS (SELECT h, max(split) AS split FROM i GROUP BY h)
    SELECT d.doc_id, CASE k.split WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents d JOIN k ON sha1(d.text) = k.h"""
)
def j01_split_join(spark: SparkSession, sf: str) -> DataFrame:
    """Texts keep the split they had; of a text in both, the validation split wins."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha1("text").alias("h"))
    index = R.override_union([d.where("doc_id % 5 <> 0").withColumn("split", F.lit("train")), d.where("doc_id % 5 = 0").withColumn("split", F.lit("val"))], ["h"], [F.col("doc_id")])
    return d.join(index.select("h", "split"), "h").select("doc_id", "split")


@query(
    """SELECT q.pos, q.item_id, a.doc_id, coalesce(a.lang, q.lang) AS lang FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, lang FROM eval_items) q JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang FROM documents) a USING (pos)"""
)
def j11_zip_join(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th item beside the n-th document; the document's language wins where it has one."""
    e, d = table(spark, sf, "eval_items").select("item_id", "lang"), table(spark, sf, "documents").select("doc_id", "lang")
    left, right = R.row_index(e, [], "item_id", F.floor(F.col("item_id") / 100_000), "pos"), R.row_index(d, [], "doc_id", F.floor(F.col("doc_id") / 100_000), "pos")
    return R.zip_join(left, right, "pos").select("pos", "item_id", "doc_id", "lang")


@query("SELECT a.culture, a.arm, d.domain FROM arm_manifest a, (SELECT DISTINCT lower(trim(domain)) AS domain FROM documents WHERE trim(domain) <> '') d")
def j13_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Every arm with every domain: both sides are small reference lists."""
    domains = table(spark, sf, "documents").select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''").distinct()
    return table(spark, sf, "arm_manifest").select("culture", "arm").crossJoin(domains)


@query("SELECT c.c_mktsegment AS segment, coalesce(r.r_name, 'other') AS region, count(*) AS n, round(sum(c.c_acctbal), 4) AS balance FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def j15_dimension_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.groupBy(F.col("c_mktsegment").alias("segment"), F.coalesce("r_name", F.lit("other")).alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w07_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return R.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("SELECT id, min(batch_no) AS first_batch, count(*) AS deliveries FROM grounded GROUP BY id")
def w05_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").groupBy("id").agg(F.min("batch_no").alias("first_batch"), F.count("*").alias("deliveries"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents")
def w01_row_index(spark: SparkSession, sf: str) -> DataFrame:
    return R.row_index(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", F.floor(F.col("doc_id") / 100_000), "idx")


_SIZED = f"SELECT coalesce(lang, '?') AS lang, doc_id, coalesce(len({tokens_sql('text')}), 0) AS tok, sha256('7:' || coalesce(lang, '?') || ':' || doc_id) AS h FROM documents"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.coalesce("lang", F.lit("?"))
    return table(spark, sf, "documents").select(lang.alias("lang"), "doc_id", X.token_count(F.col("text")).alias("tok"), X.seeded_order("7", lang, F.col("doc_id")).alias("h"))


@query(f"WITH s AS ({_SIZED}), r AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY lang ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT lang, doc_id, tok FROM r WHERE before < 4000")
def w02_budget_stop_after(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_budget(_sized(spark, sf), "lang", "tok", "h", F.lit(4000), crossing=True).select("lang", "doc_id", "tok")


@query(f"WITH s AS ({_SIZED}), r AS (SELECT *, sum(tok) OVER (PARTITION BY lang ORDER BY h) AS upto, row_number() OVER (PARTITION BY lang ORDER BY h) AS rn FROM s WHERE tok > 0) SELECT lang, doc_id, tok FROM r WHERE upto <= 4000 OR rn = 1")
def w03_budget_stop_before(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_budget(_sized(spark, sf).where("tok > 0"), "lang", "tok", "h", F.lit(4000), crossing=False).select("lang", "doc_id", "tok")


@query("SELECT domain, doc_id FROM (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS rn FROM documents WHERE n_chars >= 500) WHERE rn <= 5")
def w04_group_quota(spark: SparkSession, sf: str) -> DataFrame:
    return R.quota(table(spark, sf, "documents").where("n_chars >= 500").select("domain", "doc_id"), "domain", [F.col("doc_id")], 5)


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id)) AS turn FROM documents WHERE lang IS NOT NULL AND n_chars BETWEEN 200 AND 4000)
    SELECT lang, doc_id, turn FROM r ORDER BY turn, lang LIMIT 60"""
)
def w09_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND n_chars BETWEEN 200 AND 4000").select("lang", "doc_id")
    return R.round_robin(d, "lang", [X.seeded_order("3", F.col("doc_id"))], 60)


@query("SELECT country, variant, a008, lag(a008) OVER w AS before, first_value(a008) OVER w AS first_value FROM (SELECT country, variant, min(a008) AS a008 FROM answer_grid GROUP BY country, variant) WINDOW w AS (PARTITION BY country ORDER BY variant)")
def w08_curve(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("country").orderBy("variant")
    g = table(spark, sf, "answer_grid").groupBy("country", "variant").agg(F.min("a008").alias("a008"))
    return g.select("country", "variant", "a008", F.lag("a008").over(w).alias("before"), F.first("a008").over(w).alias("first_value"))


@query("SELECT user_id, event_id, array_to_string(list_transform(coalesce(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), lambda x: x::VARCHAR), ',') AS seen FROM events")
def w16_avoid_list(spark: SparkSession, sf: str) -> DataFrame:
    """What came before in the same scenario (the last three)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    return table(spark, sf, "events").select("user_id", "event_id", F.array_join(F.transform(F.collect_list("event_id").over(w), lambda x: x.cast("string")), ",").alias("seen"))


@query(
    r"""SELECT doc_id, (2 * len(regexp_extract_all(text, 'a')) + len(regexp_extract_all(text, '\d')))::INT AS score FROM documents WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 25"""
)
def l01_top_k(spark: SparkSession, sf: str) -> DataFrame:
    score = 2 * F.regexp_count("text", F.lit("a")) + F.regexp_count("text", F.lit(r"\d"))
    return R.top_k(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", score.alias("score")), [F.desc("score"), F.col("doc_id")], 25)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def l02_limit_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return R.quota(table(spark, sf, "documents").select("source", "doc_id"), "source", [F.col("doc_id")], 3)


@query("SELECT domain, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY domain ORDER BY n DESC, domain LIMIT 5")
def l03_most_common(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(5)


@query(
    """WITH u AS (SELECT 'd' || doc_id AS k FROM documents UNION ALL SELECT 'e' || item_id FROM eval_items)
    SELECT k, row_number() OVER (ORDER BY sha256('42:' || k), k) AS place FROM u"""
)
def l04_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded order of a union: range-sorted by hash, numbered by partition offsets."""
    u = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("k")).unionByName(table(spark, sf, "eval_items").select(F.concat(F.lit("e"), F.col("item_id")).alias("k")))
    hashed = u.withColumn("h", X.seeded_order("42", F.col("k"))).withColumn("s", F.substring("h", 1, R.SLICE_DIGITS))
    counts = hashed.groupBy("s").agg(F.count("*").alias("m"))  # at most 16**SLICE_DIGITS rows
    before = F.coalesce(F.sum("m").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("s").orderBy("h", "k"))
    return hashed.withColumn("r", within).join(counts.select("s", before.alias("before")), "s").select("k", (F.col("before") + F.col("r")).alias("place"))


@query(
    f"""WITH s AS (SELECT source, doc_id, coalesce(len({tokens_sql('text')}), 0) AS tok, sha256('5:' || source || ':' || doc_id) AS h FROM documents WHERE source IN ('harbor-notes', 'hill-notes')),
    b AS (SELECT 0.5 * min(t) AS budget FROM (SELECT source, sum(tok) AS t FROM s GROUP BY source)), r AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT source, doc_id, tok FROM r, b WHERE before < budget"""
)
def l07_twin_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Both arms drawn to half the tokens of the smaller one."""
    d = table(spark, sf, "documents").where(F.col("source").isin("harbor-notes", "hill-notes"))
    sized = d.select("source", "doc_id", X.token_count(F.col("text")).alias("tok"), X.seeded_order("5", F.col("source"), F.col("doc_id")).alias("h"))
    budget = sized.groupBy("source").agg(F.sum("tok").alias("t")).agg((F.min("t") * 0.5).alias("budget"))
    joined = sized.crossJoin(F.broadcast(budget))  # one row
    return R.running_budget(joined, "source", "tok", "h", F.col("budget"), crossing=True).select("source", "doc_id", "tok")


@query(
    """WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('9:' || doc_id)) AS rn FROM documents)
    SELECT r.lang, r.doc_id FROM r JOIN n USING (lang) WHERE r.rn <= ceil(n.n * 0.1)"""
)
def l12_stratified(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select("lang", "doc_id")
    return R.share_of_each(d.withColumn("h", X.seeded_order("9", F.col("doc_id"))), "lang", "h", "doc_id", 0.1).select("lang", "doc_id")


@query(
    """WITH w AS (SELECT source, target_share * 20 AS w FROM mix_targets), r AS (SELECT d.doc_id, d.source, w.w, ('0x' || substr(sha256('13:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents d JOIN w USING (source))
    SELECT doc_id, source, (floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r WHERE floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END > 0"""
)
def l14_weighted_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Up- and down-sampling by source weight: whole copies, the fraction decided by hash."""
    w = table(spark, sf, "mix_targets").select("source", (F.col("target_share") * 20).alias("w"))
    u = F.conv(F.substring(X.seeded_order("13", F.col("doc_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    d = table(spark, sf, "documents").select("doc_id", "source").join(w, "source").withColumn("u", u)
    copies = F.floor("w") + F.when(F.col("u") < F.col("w") - F.floor("w"), 1).otherwise(0)
    return d.select("doc_id", "source", copies.alias("copies")).where("copies > 0")


@query("SELECT epoch, item_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256('1:' || epoch || ':' || item_id)) AS place FROM eval_items, (SELECT unnest([0, 1, 2]) AS epoch)")
def l15_epoch_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items").select("item_id", F.explode(F.array(*map(F.lit, range(3)))).alias("epoch"))
    return e.select("epoch", "item_id", F.row_number().over(W.partitionBy("epoch").orderBy(X.seeded_order("1", F.col("epoch"), F.col("item_id")))).alias("place"))


@query("SELECT testset, item_id FROM (SELECT testset, item_id, row_number() OVER (PARTITION BY testset, lang ORDER BY sha256('8:' || item_id)) AS rn FROM eval_items) WHERE rn = 1")
def l16_seeded_choice(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items")
    return R.first(e.select("testset", "lang", "item_id"), ["testset", "lang"], [X.seeded_order("8", F.col("item_id"))]).select("testset", "item_id")


@query("SELECT 'listed' AS side, source FROM (SELECT DISTINCT source FROM mix_targets EXCEPT SELECT source FROM documents) UNION ALL SELECT 'found', source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM mix_targets)")
def u03_key_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    m = R.key_mismatch(table(spark, sf, "mix_targets"), table(spark, sf, "documents").where("source IS NOT NULL"), ["source"])
    return m.select(F.when(F.col("side") == "left", "listed").otherwise("found").alias("side"), "source")


@query("SELECT lang FROM (SELECT lang FROM documents INTERSECT SELECT lang FROM eval_items)")
def u04_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang").intersect(table(spark, sf, "eval_items").select("lang"))


@query("SELECT kind, lang, count(*) AS n FROM (SELECT 'documents' AS kind, lang FROM documents UNION ALL SELECT 'eval_items', lang FROM eval_items) GROUP BY kind, lang")
def u01_union_all(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lit("documents").alias("kind"), "lang")
    return d.unionByName(table(spark, sf, "eval_items").select(F.lit("eval_items").alias("kind"), "lang")).groupBy("kind", "lang").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, lower(trim(domain)) AS domain FROM documents")
def u05_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source", F.lower(F.trim("domain")).alias("domain")).distinct()


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate IS NULL OR (year(o_orderdate) >= 1996 AND year(o_orderdate) <= 1998)")
def row_p08_recency(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where("o_orderdate IS NULL OR (o_orderdate >= DATE'1996-01-01' AND o_orderdate < DATE'1999-01-01')").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 400 AND 1200 AND len(list_filter(regexp_split_to_array(trim(text), '[\\s\\x0B]+'), lambda x: x <> '')) >= 20")
def row_p10_length_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.length("text").between(400, 1200) & (X.word_count(F.col("text")) >= 20)).select("doc_id")


@query("SELECT doc_id, coalesce(nullif(trim(domain), ''), nullif(trim(register), ''), nullif(trim(source), '')) AS subject FROM documents")
def row_p01_first_present(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.first_present(F.col("domain"), F.col("register"), F.col("source")).alias("subject"))


@query(r"SELECT scenario_id, universal FROM (SELECT doc_id AS scenario_id, domain NOT IN ('law', 'religion') AND NOT regexp_matches(coalesce(source, '') || ' ' || coalesce(text, ''), '(?i)vietnam|việt|harbor') AS universal FROM documents WHERE domain IS NOT NULL)")
def row_p12_markers(spark: SparkSession, sf: str) -> DataFrame:
    blob = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").where("domain IS NOT NULL").select(F.col("doc_id").alias("scenario_id"), (~F.col("domain").isin("law", "religion") & ~blob.rlike("(?iu)vietnam|việt|harbor")).alias("universal"))


@query("SELECT item_id, CASE WHEN contains(text, ' A) ') THEN 'choice' ELSE 'open' END AS kind FROM eval_items")
def row_p14_union_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items")
    has = F.contains("text", F.lit(" A) "))
    return e.where(has).select("item_id", F.lit("choice").alias("kind")).union(e.where(~has).select("item_id", F.lit("open")))


@query("SELECT node_id, round_num, quality FROM contribution_scores WHERE quality >= 0.7 AND quality > 0 AND NOT isnan(quality) AND NOT isinf(quality)")
def row_p23_floor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contribution_scores").where("quality >= 0.7 AND quality > 0 AND NOT isnan(quality) AND abs(quality) < double('infinity')").select("node_id", "round_num", "quality")


_TURNS = "SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn, CASE WHEN event_type IN ('view', 'click') THEN 'user' WHEN event_type = 'signup' THEN 'system' ELSE 'assistant' END AS role, props AS text FROM events"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("event_type").isin("view", "click"), "user").when(F.col("event_type") == "signup", "system").otherwise("assistant")
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select(F.col("user_id").alias("conv"), turn.alias("turn"), role.alias("role"), F.col("props").alias("text"))


@query(f"WITH t AS ({_TURNS}), u AS (SELECT conv, min(turn) AS ut, arg_min(text, turn) AS asked FROM t WHERE role = 'user' GROUP BY conv) SELECT u.conv, u.ut, u.asked, arg_min(t.text, t.turn) AS answered FROM u JOIN t ON t.conv = u.conv AND t.role = 'assistant' AND t.turn > u.ut GROUP BY 1, 2, 3")
def row_p17_first_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """First user turn of a conversation and the first assistant turn after it."""
    t = _turns(spark, sf)
    u = t.where("role = 'user'").groupBy("conv").agg(F.min("turn").alias("ut"), F.min_by("text", "turn").alias("asked"))
    a = t.where("role = 'assistant'").select("conv", F.col("turn").alias("at"), F.col("text").alias("said"))
    return u.join(a, "conv").where("at > ut").groupBy("conv", "ut", "asked").agg(F.min_by("said", "at").alias("answered"))


@query(f"WITH t AS ({_TURNS}) SELECT conv, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max(length(text)) FILTER (role = 'user') AS longest, arg_min(role, turn) = 'user' AS opens_with_user FROM t WHERE NOT (role = 'system' AND coalesce(trim(text), '') = '') GROUP BY conv")
def row_p15_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations without blank system turns: size, longest user turn, who opens."""
    t = _turns(spark, sf).where("NOT (role = 'system' AND coalesce(trim(text), '') = '')")
    user = F.col("role") == "user"
    return t.groupBy("conv").agg(F.count("*").alias("turns"), F.count_if(user).alias("asked"), F.max(F.when(user, F.length("text"))).alias("longest"), (F.min_by("role", "turn") == "user").alias("opens_with_user"))


@query("SELECT count(*) AS kept FROM documents d WHERE d.source = 'hill-notes' AND sha1(d.text) NOT IN (SELECT sha1(text) FROM documents WHERE source = 'harbor-notes' AND text IS NOT NULL)")
def j22_dedupe_against_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one source whose text does not stand in another."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("source", F.sha1("text").alias("h"))
    return R.pending(d.where("source = 'hill-notes'"), d.where("source = 'harbor-notes'"), ["h"]).agg(F.count("*").alias("kept"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click' AND value > 20) WHERE rn = 1")
def w06_first_after_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'click' AND value > 20").select("user_id", "event_id", "value", "ts")
    return R.first(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT e.item_id, coalesce(nullif(trim(e.axis), ''), e.testset) AS axis, e.lang FROM eval_items e")
def j21_fill_left(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", X.first_present(F.col("axis"), F.col("testset")).alias("axis"), "lang")


@query(
    """WITH n AS (SELECT source, least(count(*), 12) AS want FROM documents WHERE source IS NOT NULL GROUP BY source), b AS (SELECT source, want, ceil(want * 1.15) AS buffer FROM n), r AS (SELECT source, doc_id, length(text) >= 200 AS ok, row_number() OVER (PARTITION BY source ORDER BY sha256('2:' || doc_id)) AS rn FROM documents WHERE source IS NOT NULL),
    k AS (SELECT r.source, r.doc_id, row_number() OVER (PARTITION BY r.source ORDER BY r.rn) AS place, b.want FROM r JOIN b ON r.source = b.source AND r.rn <= b.buffer WHERE r.ok) SELECT source, doc_id FROM k WHERE place <= want"""
)
def l13_oversample_and_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Each source drawn with a buffer of 15 %, checked, and trimmed to the wanted number."""
    d = table(spark, sf, "documents").where("source IS NOT NULL")
    want = d.groupBy("source").agg(F.least(F.count("*"), F.lit(12)).alias("want"))
    h = X.seeded_order("2", F.col("doc_id"))
    drawn = R.quota(d.select("source", "doc_id", (F.length("text") >= 200).alias("ok"), h.alias("h")).join(want, "source"), "source", [F.col("h")], F.ceil(F.col("want") * 1.15))
    return R.quota(drawn.where("ok"), "source", [F.col("h")], F.col("want")).select("source", "doc_id")


@query("SELECT id, batch_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '\\1', 'g'), '&{2,}', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '') AS url FROM grounded WHERE url IS NOT NULL")
def f43_clean_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").where("url IS NOT NULL").select("id", "batch_no", X.clean_url(F.col("url")).alias("url"))
