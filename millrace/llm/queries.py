"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from millrace.llm import languages, leaks, mixing, packing, reading_level, sampling, splitting, token_budget
from millrace.llm import near_duplicates as nd
from millrace.session import table, texts

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nd.duplicate_pairs(texts(spark, sf, "grounded"), shingle=3, threshold=0.5, min_words=20)


@query()
def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return nd.duplicate_groups(texts(spark, sf, "grounded"), every=True)


@query("SELECT count(DISTINCT id) AS ids, count(DISTINCT id) AS rows, 0 AS split_copies FROM grounded")
def p1_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """A row for every id, and equal texts that have a word in one group."""
    g = table(spark, sf, "grounded")
    groups = nd.duplicate_groups(g, every=True)
    copies = g.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("id", F.md5("text").alias("digest")).distinct().join(groups, "id").groupBy("digest").agg(F.min("group_id").alias("a"), F.max("group_id").alias("b"))
    ids, split = groups.agg(F.count_distinct("id").alias("ids"), F.count("*").alias("rows")), copies.agg(F.count_if(F.col("a") != F.col("b")).alias("split_copies"))
    return ids.crossJoin(split)  # one row each


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(texts(spark, sf, "grounded"), table(spark, sf, "eval_items"))


SAMPLE_RATE = 0.1
_LEAST = int(SAMPLE_RATE * sampling.SIDE)
_PLACED = sampling.permuted_sql("SELECT DISTINCT id FROM grounded WHERE id IS NOT NULL")


@query(f"SELECT id, place FROM ({_PLACED}) WHERE place < {_LEAST}")
def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen ids with their place in the permuted domain."""
    return sampling.stable_sample(table(spark, sf, "grounded").select("id"), SAMPLE_RATE, place_col="place").distinct()


@query(
    f"""WITH chosen AS ({_PLACED}), first AS (SELECT id, min(batch_no) AS batch_no FROM grounded GROUP BY id)
    SELECT f.batch_no, count(*) AS arrived, count(*) FILTER (c.place < {_LEAST}) AS chosen FROM first f JOIN chosen c USING (id) GROUP BY f.batch_no"""
)
def p3_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Ids first seen with each batch, and how many of them the sample holds for good."""
    first = table(spark, sf, "grounded").groupBy("id").agg(F.min("batch_no").alias("batch_no")).where("id IS NOT NULL")
    return first.groupBy("batch_no").agg(F.count("*").alias("arrived"), F.count_if(sampling.place_of(F.col("id")) < _LEAST).alias("chosen"))


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(texts(spark, sf, "grounded"))


@query()
def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(texts(spark, sf, "grounded")).drop("version")


@query("SELECT DISTINCT id, md5(text) AS digest, length(text) AS n FROM grounded WHERE text IS NOT NULL")
def p5_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each text without their overlaps, put together again; none over the limit."""
    pieces = splitting.pieces(table(spark, sf, "grounded"))
    rest = F.substr("text", F.col("overlap").cast("int") + 1)
    whole = pieces.groupBy("id", "version").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", rest.alias("t")))), lambda x: x["t"]), "").alias("t"), F.max(F.length("text")).alias("longest"))
    return whole.where("longest <= 2000").select("id", F.md5("t").alias("digest"), F.length("t").alias("n")).distinct()


def _language_model(spark: SparkSession, sf: str) -> languages.Model:
    """Fitted on labelled whole rows of both tables, at most 300 a language."""
    labelled = [table(spark, sf, t).select("text", languages.label_code(F.col("lang")).alias("code")) for t in ("documents", "grounded")]
    return languages.fit(labelled[0].union(labelled[1]))


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.label_issues(texts(spark, sf, "grounded"), _language_model(spark, sf))


@query()
def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    return languages.detect(texts(spark, sf, "grounded"), _language_model(spark, sf)).drop("stored").distinct()


def _ledger(spark: SparkSession, sf: str) -> token_budget.TokenLedger:
    """Budget kept over two deliveries: batches 0 to 8, then the later ones with the re-deliveries among them."""
    docs = table(spark, sf, "grounded").select("id", "text", "source", "lang", "domain", "batch_no", "fetched_at")
    ledger = token_budget.TokenLedger(spark)
    ledger.update(docs.where("batch_no <= 8"))
    ledger.update(docs.where("batch_no > 8 OR batch_no IS NULL"))
    return ledger


@query()
def p2_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).totals()


_NONE = "('', 'none', 'n/a')"
_TRIM = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_SOURCE = f"regexp_replace({_TRIM.format('source')}, '[\\s_]+', '-', 'g')"
_DOMAIN = f"regexp_replace({_TRIM.format('domain')}, '^topic:\\s*', '')"
_BARE = f"lower(regexp_replace(trim(regexp_replace(lang, '^\\s+|\\s+$', '', 'g')), '^([A-Za-z]{{2,3}})[-_][A-Za-z0-9]{{2,4}}$', '\\1'))"
_CODES = " ".join(f"WHEN '{x}' THEN '{code}'" for code in languages.LANGS for x in [code, *languages.NAMES[code]])


@query(
    f"""SELECT source, lang, domain, count(DISTINCT id) AS docs FROM (SELECT id, CASE WHEN source IS NULL OR {_SOURCE} IN {_NONE} THEN 'unknown' ELSE {_SOURCE} END AS source, coalesce(CASE {_BARE} {_CODES} END, 'unknown') AS lang,
    CASE WHEN domain IS NULL OR {_DOMAIN} IN {_NONE} THEN 'unknown' ELSE {_DOMAIN} END AS domain FROM grounded) GROUP BY 1, 2, 3"""
)
def p2_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each cell of the cube."""
    return _ledger(spark, sf).cube().select("source", "lang", "domain", "docs")


@query()
def p2_document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).document_tokens()


CAPACITY = 2048


@query()
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(texts(spark, sf, "documents"), CAPACITY)


@query()
def p7_usage(spark: SparkSession, sf: str) -> DataFrame:
    return packing.usage_report(texts(spark, sf, "documents"), CAPACITY)


@query("SELECT count(DISTINCT doc_id) AS documents, 0 AS over_capacity, 0 AS repeated_parts, 0 AS needlessly_divided FROM documents")
def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Every document once, no container over its capacity, nothing divided that fits."""
    return packing.invariants(packing.pack_documents(texts(spark, sf, "documents"), CAPACITY), CAPACITY)


@query()
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@query()
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(texts(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


@query("SELECT count(DISTINCT source) AS sources, 0 AS over_cap, 0 AS unlisted, true AS shares_add_up FROM mix_targets WHERE target_share > 0")
def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Every listed source has a row, no document is used more often than its source allows, none of another source is used, shares add up to 1."""
    used, shares = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    j = used.join(shares.select("source", "max_repeats"), "source", "left").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("max_repeats").isNull()).alias("unlisted"))
    total = shares.agg(F.count("*").alias("sources"), (F.abs(F.sum("actual_share") - 1) < 1e-9).alias("shares_add_up"))
    return total.crossJoin(j).select("sources", "over_cap", "unlisted", "shares_add_up")  # one row each


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "reading_labels")
    return reading_level.grades(reading_level.reading_levels(texts(spark, sf, "documents"), table(spark, sf, "lang_norms"), labels), labels)


@query()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.bands(_graded(spark, sf), table(spark, sf, "lang_norms"))


@query()
def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf)


@query()
def p9_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How well levels from half of the grades foretell the other half."""
    return reading_level.agreement(texts(spark, sf, "documents"), table(spark, sf, "lang_norms"), table(spark, sf, "reading_labels"))
