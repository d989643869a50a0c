"""Queries over text: normalising, tokens, parsing, rendering, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import survey
from millrace.functions import text as X
from millrace.plans.registry import norm_sql, query, tokens_sql, words_sql
from millrace.session import table


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normalized FROM documents")
def f01_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("normalized"))


@query(f"SELECT source, lang, sum(coalesce(len({tokens_sql('text')}), 0))::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY source, lang")
def f02_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum(X.token_count(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))


@query(f"SELECT doc_id, sha1({norm_sql('text')}) AS digest FROM documents")
def f03_sha1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha1(X.normalize(F.col("text"))).alias("digest"))


@query(
    f"""WITH t AS (SELECT item_id, {tokens_sql('text')} AS w FROM eval_items),
    g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS gram FROM t)
    SELECT gram, count(*) AS n, count(DISTINCT item_id) AS items FROM g GROUP BY gram"""
)
def f05_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = table(spark, sf, "eval_items").select("item_id", F.explode(X.ngrams(X.tokens(F.col("text")), 13)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(doc_id::VARCHAR || ':' || source), 1, 16))::UBIGINT AS DECIMAL(20, 0)) AS seed FROM documents WHERE source IS NOT NULL")
def f06_stable_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", X.stable_seed(F.col("doc_id"), F.col("source")).alias("seed"))


@query("SELECT ('0x' || substr(md5(id), 1, 8))::BIGINT % 7 AS worker, count(*) AS n, count(DISTINCT id) AS ids FROM grounded GROUP BY 1")
def f07_worker_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").groupBy(X.md5_bucket(F.col("id"), 7).alias("worker")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    """SELECT doc_id, printf('rhsl_%s_%s_%06d', substr(replace(replace(register, '_shaped', ''), '_', ''), 1, 8), substr(regexp_replace(source, '[^A-Za-z0-9]', '', 'g'), 1, 10), doc_id) AS rid
    FROM documents WHERE source IS NOT NULL AND register IS NOT NULL"""
)
def f08_record_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source IS NOT NULL AND register IS NOT NULL").select("doc_id", X.record_id(F.col("register"), F.col("source"), F.col("doc_id")).alias("rid"))


_WRAP = "'<THINK>' || chr(10) || trim(testset) || chr(10) || '</THINK>' || chr(10) || '<ANSWER>' || chr(10) || trim(text) || chr(10) || '</ANSWER>'"


@query(
    rf"""WITH w AS (SELECT item_id, {_WRAP} AS m FROM eval_items)
    SELECT item_id, md5(m) AS wrapped, trim(regexp_extract(m, '(?s)<THINK>(.*?)</THINK>', 1), e' \n') AS thought, md5(trim(regexp_extract(m, '(?s)<ANSWER>(.*?)</ANSWER>', 1), e' \n')) AS answer FROM w"""
)
def f09_wrap_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = table(spark, sf, "eval_items").select("item_id", X.wrap_assistant(F.col("testset"), F.col("text")).alias("m"))
    return wrapped.select("item_id", F.md5("m").alias("wrapped"), X.tagged(F.col("m"), X.THINK).alias("thought"), F.md5(X.tagged(F.col("m"), X.ANSWER)).alias("answer"))


@query(
    r"""WITH o AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, ' ?[A-D]\) '), lambda x: x <> '') AS p FROM eval_items WHERE regexp_matches(text, ' A\) '))
    SELECT item_id, trim(p[1]) || chr(10) || chr(10) || array_to_string(list_transform(p[2:], lambda x, i: chr((64 + i)::INT) || ') ' || trim(x)), chr(10)) AS rendered FROM o"""
)
def f10_format_choices(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.split("text", r" ?[A-D]\) "), lambda x: x != "")
    rows = table(spark, sf, "eval_items").where(F.col("text").rlike(r" A\) ")).select("item_id", parts.alias("p"))
    return rows.select("item_id", X.format_mc(F.get("p", F.lit(0)), F.slice("p", 2, 14)).alias("rendered"))


@query(
    r"""WITH t AS (SELECT doc_id, 'work it out #### $' || n_chars || ',' || (doc_id % 1000) || '.50 so \boxed{' || doc_id || '} and \boxed{\frac{' || n_chars || '}{2}}, the answer is: $' || n_chars || '.' AS s FROM documents)
    SELECT doc_id, ltrim(replace(regexp_extract(s, '####\s*([-$0-9.,]+)', 1), ',', ''), '$') AS final, '\frac{' || regexp_extract(s, 'frac\{(\d+)', 1) || '}{2}' AS boxed,
    rtrim(replace(regexp_extract(s, '(?i)answer is[:\s]+\$?([-0-9.,]+)', 1), ',', ''), '.') AS said FROM t"""
)
def f11_parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(
        F.lit("work it out #### $"), F.col("n_chars"), F.lit(","), F.col("doc_id") % 1000, F.lit(".50 so \\boxed{"), F.col("doc_id"), F.lit("} and \\boxed{\\frac{"), F.col("n_chars"), F.lit("}{2}}, the answer is: $"), F.col("n_chars"), F.lit(".")
    )
    t = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return t.select("doc_id", X.final_number(F.col("s")).alias("final"), X.boxed(F.col("s")).alias("boxed"), X.said_answer(F.col("s")).alias("said"))


@query("SELECT s_suppkey, CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS plain FROM (SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS v FROM supplier)")
def f15_plain_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", X.plain_number(F.col("s_acctbal").cast("decimal(12,2)")).alias("plain"))


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^\(?\d+[.):][\s\x0B]*', ''), '^[-*•][\s\x0B]*', ''), '^["''“”]+|["''“”]+$', '', 'g'))), lambda x: x <> '') AS q FROM documents)
    SELECT doc_id, len(q)::INT AS lines, md5(array_to_string(q, '|')) AS digest FROM l"""
)
def f16_question_lines(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select("doc_id", X.question_lines(F.col("text")).alias("q"))
    return q.select("doc_id", F.when(F.col("q").isNotNull(), F.size("q")).alias("lines"), F.md5(F.array_join("q", "|")).alias("digest"))


MARKERS = ["the", "village", "đã", "của", "och"]
MARKS = "åäöéèđăâêôơư"


@query(rf"SELECT id, batch_no, (2 * len(regexp_extract_all(' ' || lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '  ', 'g')) || ' ', ' ({'|'.join(MARKERS)}) ')) + len(regexp_extract_all(lower(text), '[{MARKS}]')))::INT AS cues FROM grounded")
def f19_cue_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").select("id", "batch_no", X.cue_score(F.col("text"), MARKERS, MARKS).alias("cues"))


@query("SELECT id, batch_no, replace(replace(replace(lower(domain), ' ', '_'), '(', ''), ')', '') AS slug, replace(lower(trim(license)), ' ', '-') AS license FROM grounded")
def f20_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grounded").select("id", "batch_no", X.slug(F.col("domain")).alias("slug"), X.canonical_license(F.col("license")).alias("license"))


@query()
def f22_sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentence_chunks(F.col("text"), 60)).alias("chunk", "piece"))
    return chunks.select("doc_id", "chunk", X.word_count(F.col("piece")).alias("words"), F.md5("piece").alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1024 THEN substr(text, 1, 512) || chr(10) || '[...]' || chr(10) || right(text, 512) ELSE text END) AS trimmed FROM documents")
def f23_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.head_tail(F.col("text"), 128)).alias("trimmed"))


WINDOW, LEAST_WINDOW = 65, 64


@query(
    f"""WITH t AS (SELECT doc_id, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= {WINDOW} THEN w ELSE list_concat(w[1:{WINDOW // 2}], w[len(w) - {WINDOW - WINDOW // 2 - 1}:len(w)]) END, ' ')) AS digest, least(len(w), {WINDOW})::INT AS kept FROM t WHERE len(w) <= {WINDOW} OR {WINDOW} >= {LEAST_WINDOW}"""
)
def f24_token_window(spark: SparkSession, sf: str) -> DataFrame:
    """Every text: one that fits is kept whole, a longer one is dropped only if the window is under the least."""
    t = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.words_of(F.col("text")).alias("w"))
    fits = t.where((F.size("w") <= WINDOW) | F.lit(WINDOW >= LEAST_WINDOW))
    kept = fits.select("doc_id", X.token_window(F.col("w"), F.lit(WINDOW)).alias("k"))
    return kept.select("doc_id", F.md5(F.array_join("k", " ")).alias("digest"), F.size("k").alias("kept"))


@query(
    r"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'so <ANSWER> (' || chr((65 + doc_id % 5)::INT) || ') </ANSWER> done' WHEN 1 THEN 'The best answer is: (' || chr((97 + doc_id % 4)::INT) || ').' WHEN 2 THEN '<ANSWER>x</ANSWER> the answer is **C' ELSE 'no idea' END AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 5 < 4 THEN chr((65 + doc_id % 5)::INT) WHEN doc_id % 4 = 1 THEN upper(chr((97 + doc_id % 4)::INT)) WHEN doc_id % 4 = 2 THEN 'C' END AS letter,
    CASE WHEN doc_id % 4 = 0 AND doc_id % 5 < 4 THEN 'answer-tag' WHEN doc_id % 4 IN (1, 2) THEN 'answer-is' ELSE 'no-answer-spiral' END AS rule FROM m"""
)
def f27_answer_letter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    up, low = F.chr(65 + d % 5), F.chr(97 + d % 4)
    t = (
        F.when(d % 4 == 0, F.concat(F.lit("so <ANSWER> ("), up, F.lit(") </ANSWER> done")))
        .when(d % 4 == 1, F.concat(F.lit("The best answer is: ("), low, F.lit(").")))
        .when(d % 4 == 2, F.lit("<ANSWER>x</ANSWER> the answer is **C"))
        .otherwise(F.lit("no idea"))
    )
    rows = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", X.answer_letter(F.col("t")).alias("letter"), X.answer_rule(F.col("t")).alias("rule"))


@query(
    r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '-?\d+'), lambda x: TRY_CAST(x AS INT)), lambda v: v BETWEEN 1 AND 10)[1] AS first_int,
    CASE WHEN len(regexp_extract_all(text, '\d+')) < 2 THEN NULL ELSE
      (SELECT CASE WHEN list_sort(list_distinct([a, b])) = [1, 3] THEN 1 WHEN list_sort(list_distinct([a, b])) = [2, 4] THEN 3 ELSE 2 END FROM (SELECT TRY_CAST(regexp_extract_all(text, '\d+')[1] AS BIGINT) AS a, TRY_CAST(regexp_extract_all(text, '\d+')[2] AS BIGINT) AS b)) END AS choices,
    nullif(upper(regexp_extract(text, '(?i)^\s*\(?\**(?:option\s*)?([ABC])(?:$|[^\p{L}\p{N}_])', 1)), '') AS letter
    FROM documents WHERE text IS NOT NULL"""
)
def f29_survey_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull())
    t = F.col("text")
    return rows.select("doc_id", survey.first_int(t, 1, 10).alias("first_int"), survey.two_choices(t).alias("choices"), survey.lead_letter(t).alias("letter"))


@query(
    """WITH t AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Religious faith, Obedience' WHEN 1 THEN 'Independence and Determination' WHEN 2 THEN 'Obedience; Independence' WHEN 3 THEN '(B) might do' WHEN 4 THEN 'People can be trusted' ELSE text END AS s FROM eval_items)
    SELECT item_id, ((CASE WHEN contains(s, 'Religious faith') THEN 1 ELSE 2 END) + (CASE WHEN contains(s, 'Obedience') THEN 1 ELSE 2 END) - (CASE WHEN contains(s, 'Independence') THEN 1 ELSE 2 END) - (CASE WHEN contains(s, 'Determination') THEN 1 ELSE 2 END))::INT AS autonomy,
    CASE WHEN item_id % 6 = 3 THEN 2 WHEN regexp_matches(s, '(?i)^\\s*\\(?\\**(?:option\\s*)?A\\b') THEN 1 END AS petition,
    CASE WHEN item_id % 6 = 3 THEN 2 WHEN item_id % 6 = 4 OR regexp_matches(s, '(?i)^\\s*\\(?\\**(?:option\\s*)?A\\b') THEN 1 END AS trust FROM t"""
)
def f30_survey_phrases(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 6
    s = F.when(i == 0, "Religious faith, Obedience").when(i == 1, "Independence and Determination").when(i == 2, "Obedience; Independence").when(i == 3, "(B) might do").when(i == 4, "People can be trusted").otherwise(F.col("text"))
    t = table(spark, sf, "eval_items").select("item_id", s.alias("s"))
    c = F.col("s")
    return t.select("item_id", survey.autonomy(c).alias("autonomy"), survey.by_phrase("e025", c).alias("petition"), survey.by_phrase("a165", c).alias("trust"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 < 4 THEN (doc_id % 7)::INT END WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 26 < 4 THEN (doc_id % 26)::INT END END AS answer_index FROM documents")
def f35_coerce_index(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 3 == 0, (d % 7).cast("string")).when(d % 3 == 1, F.chr(65 + d % 26)).otherwise(F.lit("True"))
    return table(spark, sf, "documents").select("doc_id", X.coerce_index(raw, 4).alias("answer_index"))


@query("SELECT item_id, CASE WHEN text IS NOT NULL THEN strlen(text)::INT END AS n_bytes, CASE WHEN text IS NOT NULL THEN hex(encode(text)) END AS bytes FROM eval_items")
def f37_byte_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every item, whatever its language, with all its bytes (as hexadecimal digits)."""
    b = table(spark, sf, "eval_items").select("item_id", X.byte_tokens(F.col("text")).alias("b"))
    return b.select("item_id", F.when(F.col("b").isNotNull(), F.size("b")).alias("n_bytes"), F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x), 2, "0")), "").alias("bytes"))


def _padded(spark: SparkSession, sf: str, tokens: Column) -> DataFrame:
    """The tokens a node reports count the pads as well."""
    ids = F.transform(tokens, lambda x: F.length(x))
    t = table(spark, sf, "eval_items").select("lang", ids.alias("ids"))
    m = t.groupBy("lang").agg(F.max(F.size("ids")).alias("w"))
    padded = t.join(m, "lang").select("lang", F.size("ids").alias("n"), X.pad_right(F.col("ids"), F.col("w")).alias("p"))
    return padded.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.size(F.slice("p", 2, 2**30))).alias("shifted_tokens"), F.sum(F.size("p") - F.col("n")).alias("pads"))


@query(
    f"""WITH t AS (SELECT lang, item_id, len({tokens_sql('text')})::INT AS n FROM eval_items), m AS (SELECT lang, max(n) AS w FROM t GROUP BY lang)
    SELECT t.lang, count(*) AS rows, sum(m.w - 1)::BIGINT AS shifted_tokens, sum(m.w - t.n)::BIGINT AS pads FROM t JOIN m USING (lang) GROUP BY t.lang"""
)
def f38_pad_and_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, padded to the longest of their language."""
    return _padded(spark, sf, X.tokens(F.col("text")))


@query(
    f"""WITH t AS (SELECT doc_id, len({tokens_sql('text')}) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (n // 128 + CASE WHEN n % 128 >= 2 THEN 1 ELSE 0 END)::INT AS windows, (CASE WHEN n % 128 = 1 THEN n - 1 ELSE n END)::INT AS kept FROM t"""
)
def f39_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.windows(X.tokens(F.col("text")), 128).alias("w"))
    return w.select("doc_id", F.size("w").alias("windows"), F.aggregate("w", F.lit(0), lambda a, x: a + F.size(x)).alias("kept"))


_CHAT = "'<|start_header_id|>' || r || '<|end_header_id|>' || chr(10) || chr(10) || trim(c) || '<|eot_id|>'"


@query(
    f"""WITH m AS (SELECT item_id, 0 AS k, 'system' AS r, axis AS c FROM eval_items WHERE axis IS NOT NULL UNION ALL SELECT item_id, 1, 'user', text FROM eval_items UNION ALL SELECT item_id, 2, 'assistant', {_WRAP.replace("trim(text)", "trim(lang)")} FROM eval_items)
    SELECT item_id, md5(string_agg({_CHAT}, '' ORDER BY k)) AS rendered, count(*)::INT AS turns FROM m GROUP BY item_id"""
)
def f49_chat_template(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "eval_items").select("item_id", X.messages(F.col("text"), F.col("testset"), F.col("lang"), F.col("axis")).alias("m"))
    return m.select("item_id", F.md5(X.chat_text(F.col("m"))).alias("rendered"), F.size("m").alias("turns"))


@query(
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len({words_sql('text')}) <= 40 THEN md5(text) ELSE md5(array_to_string(({words_sql('text')})[1:40], ' ')) END AS cut FROM documents"""
)
def l09_truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncate_words(F.col("text"), 40)).alias("cut"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<EMAIL>', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '<IP>', 'g'), '\b[0-9a-f]{40}\b', '<SECRET>', 'g'), '\+[0-9][0-9 ()-]{7,}[0-9]', '<PHONE>', 'g')) AS redacted,
    regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS has_mail FROM documents"""
)
def row_p30_redact(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.redact(t)).alias("redacted"), t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").alias("has_mail"))


@query(
    r"""WITH q AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE ELSE 0.0 END AS alpha, len(regexp_extract_all(text, '[.!?؟]')) AS stops FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, round(alpha, 6) AS alpha, (n >= 200 AND alpha >= 0.7 AND stops >= 2) AS keep FROM q"""
)
def row_p28_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    q = table(spark, sf, "documents").where(t.isNotNull()).select("doc_id", F.length(t).alias("n"), X.alpha_ratio(t).alias("alpha"), F.regexp_count(t, F.lit("[.!?؟]")).alias("stops"))
    return q.select("doc_id", F.round("alpha", 6).alias("alpha"), ((F.col("n") >= 200) & (F.col("alpha") >= 0.7) & (F.col("stops") >= 2)).alias("keep"))


@query(
    f"""SELECT lang, round(avg(length(text)), 6) AS chars, round(avg(strlen(text)), 6) AS bytes, round(avg(len({tokens_sql('text')})), 6) AS words, round(sum(strlen(text)) / nullif(sum(len({tokens_sql('text')})), 0)::DOUBLE, 6) AS bytes_per_word
    FROM documents WHERE text IS NOT NULL GROUP BY lang"""
)
def a40_token_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("lang", F.length("text").alias("c"), F.octet_length("text").alias("b"), X.token_count(F.col("text")).alias("w"))
    return d.groupBy("lang").agg(F.round(F.avg("c"), 6).alias("chars"), F.round(F.avg("b"), 6).alias("bytes"), F.round(F.avg("w"), 6).alias("words"), F.round(F.try_divide(F.sum("b").cast("double"), F.sum("w")), 6).alias("bytes_per_word"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT trim(line) AS line, count(DISTINCT doc_id) AS df FROM l WHERE trim(line) <> '' GROUP BY 1)
    SELECT line, df FROM k WHERE df >= 3"""
)
def u09_boilerplate_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", F.trim("raw").alias("line")).where("line <> ''")
    return lines.distinct().groupBy("line").agg(F.count("*").alias("df")).where("df >= 3")


@query("SELECT sha1(text) AS digest, min(doc_id) AS keeper, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def u06_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.sha1("text").alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT lang, count(*) AS n, count(DISTINCT sha1(text)) AS kinds, round(1 - count(DISTINCT sha1(text)) / count(*)::DOUBLE, 6) AS dup_ratio FROM documents WHERE text IS NOT NULL GROUP BY lang")
def a42_dedup_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(F.sha1("text")).alias("kinds"))
    return d.select("lang", "n", "kinds", F.round(1 - F.col("kinds") / F.col("n"), 6).alias("dup_ratio"))


@query(
    r"""SELECT item_id, NOT contains(text, ',') AS no_comma, upper(text) = text AS all_caps, len(regexp_extract_all(text, '[.?!]'))::INT AS stops, len(regexp_extract_all(lower(text), 'the'))::INT AS keyword, regexp_matches(text, '\?$') AS ends_with_question, regexp_matches(text, ' A\) ') AS has_options FROM eval_items"""
)
def f46_constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "eval_items").select(
        "item_id", (~F.contains(t, F.lit(","))).alias("no_comma"), (F.upper(t) == t).alias("all_caps"), F.regexp_count(t, F.lit("[.?!]")).alias("stops"), F.regexp_count(F.lower(t), F.lit("the")).alias("keyword"),
        t.rlike(r"\?$").alias("ends_with_question"), t.rlike(r" A\) ").alias("has_options"),
    )


@query("SELECT doc_id, p AS place, md5(substr(text, 1, (length(text) * p // 4)::INT) || ' NEEDLE ' || substr(text, (length(text) * p // 4)::INT + 1)) AS digest FROM documents, (SELECT unnest([0, 1, 2, 3, 4]) AS p) WHERE text IS NOT NULL AND length(text) >= 400")
def f47_needle(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.length("text") >= 400).select("doc_id", "text", F.explode(F.array(*map(F.lit, range(5)))).alias("place"))
    at = F.expr("CAST(length(text) * place div 4 AS INT)")
    return d.select("doc_id", "place", F.md5(F.concat(F.substr("text", F.lit(1), at), F.lit(" NEEDLE "), F.substr("text", at + 1))).alias("digest"))
