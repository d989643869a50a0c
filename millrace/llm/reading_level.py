"""Reading level of each document: a Rasch-style latent difficulty model.

A word ``w`` of a language is available to a document of level ``t`` with probability
``s(t - b_w)`` (logistic, ``b_w`` the difficulty of the word's occurrence) and is then
used at its own rate ``q_w``; a document's distinct prose words are draws from
``q_w s(t - b_w) / Z(t)``, so long documents are not taken for hard ones. Nothing but the
words a document uses enters its level: neither its sentences nor its averages.

The scale is tied down in two places. Documents with a reader's grade have a normal prior
at that grade (their level is known, give or take), all others one at the middle. A
word's difficulty has a normal prior at its length against the norm of the language, as
in a Rasch model whose item difficulties are regressed on a feature of the item; it gives
the scale its direction in languages without grades.

Distributed alternating optimisation, on a grid of levels:

* document step: given the word table, each document takes the level of greatest
  posterior (one pass over the documents' word lists, no shuffle);
* word step: counts per (word, level) are pre-aggregated in each batch, summed by
  word, and each word's ``b`` and ``q`` are fitted in the task that holds its counts.
  Difficulties are then shifted back to the mean of their priors;

until the difficulties of two rounds in a row agree (weighted correlation of at least
``settled``), in at most ``most_rounds`` rounds.

Words are hashed into ``2**BITS`` items a language (15 lengths times 2**15), so the word
table that is sent to all tasks is as long as the vocabulary and at most as long as that
parameter allows (7 MB a language), whatever the data. Documents' word lists are extracted once and kept as a
table in the shared folder.

A line through the readers' grades turns levels into grades. Bands: candidates are
documents whose grade lies on the easy or hard side; whether they meet the definition
(sentence length and word length) is then checked exactly.

Defined cases: null and blank texts and texts without prose have no level (null);
a null language is detected from the text; documents of a language without a norm
have no band; repeated rows of a doc_id count once; copies under other ids count each;
without usable grades the line is ``DEFAULT_LINE``; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import languages
from millrace.llm.prose import measure
from millrace.session import materialise

HASH_BITS, LENGTH_BITS = 15, 4
BITS = HASH_BITS + LENGTH_BITS
LEVELS = np.arange(-4, 4.01, 0.25)
DIFFICULTIES = np.arange(-5, 5.01, 0.25)
DEFAULT_LINE = (2.0, 8.0)  # grades a level, grade of level 0
MIDDLE, GRADES_A_LEVEL, DOUBT = 8.0, 3.0, 0.5  # what a reader's grade says of the level, and how surely
USUAL_WORD = 5.0  # letters a word where the language has no norm


def _available(level: np.ndarray, difficulty: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(level[None, :] - difficulty[:, None])))


class Items(dict):
    """word -> item number, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        low = word.lower()
        h = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> (64 - HASH_BITS)
        self[word] = h = (min(len(low), (1 << LENGTH_BITS) - 1) << HASH_BITS) | h
        return h


def prose_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, sentences, words, letters, items) of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Items()
        for batch in batches:
            told: dict[str | None, tuple] = {}
            rows = []
            for text in batch.column(2).to_pylist():
                if text not in told:
                    sentences, n, letters, found = measure(text)
                    items = np.fromiter(map(cache.__getitem__, set(found)), np.int32, -1)
                    told[text] = (sentences, n, letters, np.unique(items))
                rows.append(told[text])
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int32()))], names=["doc_id", "lang", "sentences", "words", "letters", "items"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), languages.label_code(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return source.mapInArrow(run, "doc_id long, lang string, sentences long, words long, letters long, items array<int>")


def with_language(measured: DataFrame, docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = 100) -> DataFrame:
    """Missing languages from the model of the language operator, fitted on labelled rows of the same table."""
    code = languages.label_code(F.col(lang_col).cast("string"))
    unknown = docs.where(code.isNull() & (F.length(text_col) > 0))
    if unknown.isEmpty():
        return measured
    model = languages.fit(docs.select(F.col(text_col).cast("string").alias("text"), code.alias("code")), per_lang)
    told = languages.detect(unknown, model, id_col, text_col, lang_col).groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.max("main").alias("main"))
    return measured.join(told, "doc_id", "left").withColumn("lang", F.coalesce("lang", "main")).drop("main")


class Words:
    """Difficulty and rate of the items seen: sorted numbers (language, item), so a table is as small as its vocabulary."""

    def __init__(self, langs: int, number: np.ndarray, difficulty: np.ndarray, rate: np.ndarray):
        order = np.argsort(number)
        self.langs, self.number, self.rate = langs, number[order], rate[order].astype(np.float32)
        self.row = np.rint((difficulty[order] - DIFFICULTIES[0]) / 0.25).astype(np.int8)
        self.log_norm = np.zeros((langs, len(LEVELS)))  # log Z(level) of each language
        available = _available(LEVELS, DIFFICULTIES)
        for k in range(langs):
            own = slice(*np.searchsorted(self.number, [k << BITS, (k + 1) << BITS]))
            if self.rate[own].any():
                self.log_norm[k] = np.log(np.maximum(np.bincount(self.row[own], self.rate[own], minlength=len(DIFFICULTIES)) @ available, 1e-12))
        self._rows: np.ndarray | None = None

    def rows(self) -> np.ndarray:
        """Difficulty row of every possible item, -1 for those not seen; laid out once per worker, one byte an item."""
        if self._rows is None:
            self._rows = np.full(self.langs << BITS, -1, np.int8)
            self._rows[self.number] = self.row
        return self._rows


def expected_difficulty(items: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Prior mean of the difficulty of items: their length against the norm of the language."""
    usual = np.where(np.isfinite(norm), norm, USUAL_WORD)
    return np.clip(((items >> HASH_BITS) - usual) / 3, -2, 2)


def _levels(batch: pa.RecordBatch, words: Words | None, weight: float) -> tuple:
    """(lang number, level number, item offsets, items) of each document of a batch."""
    lang = batch.column("lang_no").to_numpy(zero_copy_only=False).astype(np.int64)
    anchor = batch.column("anchor").to_numpy(zero_copy_only=False).astype(float)
    lists = batch.column("items")
    items = lists.flatten().to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
    score = np.repeat(-(LEVELS[None, :] ** 2) / 8, len(lang), axis=0)
    told = np.isfinite(anchor)
    score[told] -= (LEVELS[None, :] - anchor[told, None]) ** 2 / (2 * DOUBT**2)
    if words is not None and len(items):
        owner = np.repeat(np.arange(len(lang)), np.diff(offsets))
        row = words.rows()[(lang[owner] << BITS) + items].astype(np.int64)
        known = row >= 0
        # how often each difficulty occurs in a document, times its log availability at each level
        counts = np.bincount((owner * len(DIFFICULTIES) + row)[known], minlength=len(lang) * len(DIFFICULTIES)).reshape(len(lang), -1)
        score += weight * (counts @ np.log(_available(LEVELS, DIFFICULTIES)) - counts.sum(axis=1)[:, None] * words.log_norm[lang])
    return lang, score.argmax(axis=1), offsets, items


def _agreement(old: Words, new: Words) -> float:
    """Correlation of the difficulties of two rounds, words weighted by their rate."""
    x, y, w = old.row.astype(float), new.row.astype(float), new.rate.astype(float)  # both rounds have seen the same items
    if not w.sum():
        return 1.0
    x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
    spread = np.sqrt(np.average(x * x, weights=w) * np.average(y * y, weights=w))
    return float(np.average(x * y, weights=w) / spread) if spread > 1e-12 else 1.0


def fit_levels(measured: DataFrame, norms: dict[str, float], most_rounds: int = 8, settled: float = 0.98, weight: float = 0.25) -> DataFrame:
    """(doc_id, lang, sentences, words, letters, level); ``measured`` as from ``prose_table`` with languages filled in and an ``anchor``, the level a reader gave or null."""
    spark = measured.sparkSession
    codes = sorted(norms)
    norm = np.array([norms[c] for c in codes] + [np.nan])
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)]), F.col("lang")) if codes else F.lit(None), F.lit(len(codes)))
    numbered = measured.withColumn("lang_no", number.cast("int"))
    table = None
    for turn in range(most_rounds + 1):
        state = spark.sparkContext.broadcast(table)

        def counts(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            width = len(LEVELS)
            for batch in batches:
                lang, level, offsets, items = _levels(batch, state.value, weight)
                key = ((np.repeat(lang, np.diff(offsets)) << BITS) + items) * width + np.repeat(level, np.diff(offsets))
                key, m = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // width), pa.array((key % width).astype(np.int32)), pa.array(m)], names=["item", "level", "m"])

        with_prose = numbered.where("words > 0").select("lang_no", "anchor", "items")
        held = materialise(with_prose.mapInArrow(counts, "item long, level int, m long").groupBy("item", "level").agg(F.sum("m").alias("m")))
        exposure = np.zeros((len(codes) + 1, len(LEVELS)))
        for r in held.groupBy(F.shiftright("item", BITS).alias("k"), "level").agg(F.sum("m").alias("m")).collect():  # languages x levels
            exposure[r.k, r.level] = r.m
        logz = table.log_norm if table is not None else np.zeros_like(exposure)
        given = spark.sparkContext.broadcast((exposure / np.exp(logz), norm, turn == 0))

        def word_step(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            available = _available(LEVELS, DIFFICULTIES)
            exposed, norm, first = given.value
            for b in batches:
                grid = np.stack(b["counts"].to_numpy()) if len(b) else np.zeros((0, len(LEVELS)))
                item = b["item"].to_numpy()
                offered = np.maximum(exposed[item >> BITS] @ available.T, 1e-9)
                total = grid.sum(axis=1)
                expected = expected_difficulty(item & ((1 << BITS) - 1), norm[item >> BITS])
                # rate profiled out; the prior holds rare words at what their length says, and all words in the first round
                score = -((DIFFICULTIES[None, :] - expected[:, None]) ** 2) / 4.5
                if not first:
                    score += grid @ np.log(available).T - total[:, None] * np.log(offered)
                best = score.argmax(axis=1)
                yield pd.DataFrame({"item": b["item"], "b": DIFFICULTIES[best], "q": total / offered[np.arange(len(b)), best], "m": total})

        spread = [F.sum(F.when(F.col("level") == g, F.col("m")).otherwise(0)).cast("double") for g in range(len(LEVELS))]
        rows = held.groupBy("item").agg(F.array(*spread).alias("counts")).mapInPandas(word_step, "item long, b double, q double, m double").toPandas()  # at most items x languages
        state.destroy()
        given.destroy()
        at = rows["item"].to_numpy().astype(np.int64)
        k, w, m = at >> BITS, at & ((1 << BITS) - 1), rows["m"].to_numpy()
        b = rows["b"].to_numpy()
        for lang in range(len(codes) + 1):  # back to the mean of the priors, on the grid
            own = k == lang
            if own.any():
                b[own] -= np.rint(np.average(b[own] - expected_difficulty(w[own], norm[np.full(own.sum(), lang)]), weights=m[own]) / 0.25) * 0.25
        before, table = table, Words(len(codes) + 1, at, np.clip(b, DIFFICULTIES[0], DIFFICULTIES[-1]), rows["q"].to_numpy())
        if before is not None and _agreement(before, table) >= settled:
            break

    state = spark.sparkContext.broadcast(table)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, level, _, _ = _levels(batch, state.value, weight)
            some = batch.column("words").to_numpy() > 0
            columns = [batch.column(c) for c in ("doc_id", "lang", "sentences", "words", "letters")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(LEVELS[level], mask=~some)], names=["doc_id", "lang", "sentences", "words", "letters", "level"])

    return numbered.mapInArrow(final, "doc_id long, lang string, sentences long, words long, letters long, level double")


def given_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, given): median of the grades (1 to 16) readers gave a document."""
    return labels.where("doc_id IS NOT NULL AND grade BETWEEN 1 AND 16").select("doc_id", "reader", "grade").distinct().groupBy("doc_id").agg(F.percentile("grade", F.lit(0.5)).alias("given"))


def reading_levels(docs: DataFrame, lang_norms: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Level of each document; ``labels`` (doc_id, reader, grade) tie the scale down."""
    norms = {r.lang: float(r.norm) for r in lang_norms.where(F.col("lang").isin(languages.LANGS)).groupBy("lang").agg(F.avg("typical_word_len").alias("norm")).collect() if r.norm}
    measured = with_language(prose_table(docs, id_col, text_col, lang_col), docs, id_col, text_col, lang_col)
    if labels is None:
        anchored = measured.withColumn("anchor", F.lit(None).cast("double"))
    else:
        anchors = given_grades(labels).select("doc_id", ((F.col("given") - MIDDLE) / GRADES_A_LEVEL).alias("anchor"))
        anchored = measured.join(anchors, "doc_id", "left")
    return materialise(fit_levels(materialise(anchored), norms).dropDuplicates(["doc_id"]))


def grades(levels: DataFrame, labels: DataFrame | None) -> DataFrame:
    """School grade (1 to 16) of each level, by a line through the median grade readers gave."""
    slope, base = DEFAULT_LINE
    if labels is not None:
        line = given_grades(labels).join(levels.select("doc_id", "level"), "doc_id").agg(F.regr_slope("given", "level").alias("slope"), F.regr_intercept("given", "level").alias("base")).first()
        if line.slope is not None and line.base is not None and line.slope > 0:
            slope, base = line.slope, line.base
    return levels.withColumn("grade", F.least(F.greatest(F.lit(base) + F.lit(slope) * F.col("level"), F.lit(1.0)), F.lit(16.0)))


def agreement(docs: DataFrame, lang_norms: DataFrame, labels: DataFrame) -> DataFrame:
    """(held, correlation, mean_error): a model anchored by half of the graded documents (by hash of their id), held against the grades of the others."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    told = labels.where(half == 0)
    graded = grades(reading_levels(docs, lang_norms, told), told)
    return given_grades(labels.where(half == 1)).join(graded.where("grade IS NOT NULL"), "doc_id").agg(F.count("*").alias("held"), F.corr("given", "grade").alias("correlation"), F.avg(F.abs(F.col("given") - F.col("grade"))).alias("mean_error"))


def bands(graded: DataFrame, lang_norms: DataFrame, min_words: int = 40, easy_words: float = 9, hard_words: float = 27, easy_grade: float = 7.5, hard_grade: float = 8.5) -> DataFrame:
    """(doc_id, band): documents graded by the model at most ``easy_grade`` or at least ``hard_grade``, then the exact definition."""
    norm = lang_norms.groupBy("lang").agg(F.avg("typical_word_len").alias("norm"))
    told = graded.where(F.col("words") >= min_words).join(norm, "lang")
    per_sentence, per_word = F.col("words") / F.col("sentences"), F.col("letters") / F.col("words")
    easy = (F.col("grade") <= easy_grade) & (per_sentence <= easy_words) & (per_word < F.col("norm"))
    hard = (F.col("grade") >= hard_grade) & (per_sentence >= hard_words) & (per_word > F.col("norm"))
    return told.select("doc_id", F.when(easy, "easy").when(hard, "hard").alias("band")).where("band IS NOT NULL")
