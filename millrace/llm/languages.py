"""Missing or wrong document language labels: segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (byte
pieces of a multilingual byte-level BPE). The probability of a word is the sum over
*all* segmentations of its bytes into pieces, computed by the forward algorithm for
all new words of a batch at once; piece probabilities are fitted by
expectation-maximisation (forward-backward) on a bounded sample of labelled rows
(``per_lang`` whole rows a language, chosen by hash). Rows of the sample that the
first fit assigns to another language are left out of the second, since labels may
be wrong.

A document's words then form a chain: the most probable language path under a switch
cost is found for all doubtful documents of a batch together; a document is not doubtful
only if no stretch of it gains enough by another language to pay for a change. Every segment, and the
document, gets a language and a confidence (posterior of the language over the words
concerned, times the share of words in it for the document).

Codes and tables of names look like some language or other. In a text that changes its
language, a stretch of which less than ``SUPPORT`` of the words without digits are words seen
in at least two sample rows of its language therefore has no language (null, confidence 0)
and counts for no language of the document.

Defined cases: null, blank and wordless texts have no language (null, confidence 0);
words with digits carry no evidence; repeated rows count once; an empty table gives no rows;
a word over 64 bytes is scored in consecutive parts of 64 bytes whose log probabilities
are added, so every byte counts and every word still counts as one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tokenizers import DEFAULT, parse_ranks, ranks_file
from millrace.llm.words import WORD, fold

LANGS = ["en", "sv", "vi", "ar", "es", "fr", "de"]
#: spellings of one language besides its two-letter code (fixed values, ISO 639)
NAMES = {
    "en": ["eng", "english"],
    "sv": ["swe", "swedish"],
    "vi": ["vie", "vietnamese"],
    "ar": ["ara", "arabic"],
    "es": ["spa", "spanish"],
    "fr": ["fra", "fre", "french"],
    "de": ["deu", "ger", "german"],
}
WORD_BYTES = 64
SUPPORT = 0.25  # share of the words of a stretch that must be known words of its language
CACHE = 300_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def label_code(label: Column) -> Column:
    """Two-letter code a stored label stands for, null if it names no single language."""
    known = {x: code for code in LANGS for x in [code, *NAMES[code]]}
    bare = F.lower(F.regexp_replace(F.trim(F.regexp_replace(label, r"^\s+|\s+$", "")), r"^([A-Za-z]{2,3})[-_][A-Za-z0-9]{2,4}$", "$1"))
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.element_at(F.create_map(*pairs), bare)


class Pieces:
    """The vocabulary as a table from byte-string hash to piece number."""

    def __init__(self, raw: bytes):
        # pieces with an ASCII capital, blank or sign never stand in a folded word; all others count, whatever their length
        pieces = [p for p in parse_ranks(raw) if all(c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 for c in p)]
        self.count = len(pieces)
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        bucket = (self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << _TABLE_BITS) + 1)).astype(np.int32)
        self.depth = int((self.start[1:] - self.start[:-1]).max())

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for c in p:
            h = ((h + c + 1) * int(_MULT)) & (2**64 - 1)
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none."""
        b = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        at, end = self.start[b], self.start[b + 1]
        live = np.flatnonzero(at < end)
        for _ in range(self.depth):
            if not len(live):
                break
            p = at[live]
            hit = self.keys[p] == h[live]
            out[live[hit]] = self.ids[p[hit]]
            at[live] += 1
            live = live[~hit & (at[live] < end[live])]
        return out

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """(lengths, for l = 1, 2, ... the piece that is bytes [j - l, j) of each word, as an array [word, j], None where there is no such piece)."""
        lengths = np.array([len(w) for w in words], np.int64)
        width = int(lengths.max(initial=0))
        grid = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid[np.arange(width)[None, :] < lengths[:, None]] = flat
        valid = np.arange(1, width + 1)[None, :] <= lengths[:, None]
        h = np.zeros((len(words), width), np.uint64)
        found = []
        for size in range(1, min(self.longest, width) + 1):
            # h[:, i] is the hash of the bytes [i, i + size)
            h = (h[:, : width - size + 1] + grid[:, size - 1 :] + np.uint64(1)) * _MULT
            h ^= h >> np.uint64(29)
            ok = valid[:, size - 1 :]
            told = self.find(h[ok])
            if not (told >= 0).any():
                found.append(None)
                continue
            ids = np.full((len(words), width + 1), -1, np.int32)
            ids[:, size:][ok] = told
            found.append(ids)
        return lengths, found


def forward(lengths: np.ndarray, found: list[np.ndarray | None], theta: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: probability of the bytes before the place, summed over all segmentations."""
    n, width = len(lengths), int(lengths.max(initial=0)) + 1
    alpha = np.zeros((n, width, theta.shape[1]))
    alpha[:, 0] = 1.0
    for j in range(1, width):
        for size in range(1, min(len(found), j) + 1):
            if found[size - 1] is None:
                continue
            ids = found[size - 1][:, j]
            w = np.flatnonzero(ids >= 0)
            if len(w):
                alpha[w, j] += alpha[w, j - size] * theta[ids[w]]
    return alpha


def _in_blocks(words: list[bytes], size: int = 8192):
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for s in range(0, len(order), size):
        part = order[s : s + size]
        yield np.array(part), [words[i] for i in part]


def _parts(words: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(consecutive parts of WORD_BYTES of the words, the word of each part)."""
    coded, owner = [], []
    for i, w in enumerate(words):
        b = w.encode("utf-8", "surrogatepass")
        for s in range(0, max(1, len(b)), WORD_BYTES):
            coded.append(b[s : s + WORD_BYTES])
            owner.append(i)
    return coded, np.array(owner, np.int64)


class Model:
    """Piece probabilities of each language."""

    def __init__(self, raw: bytes, counts: list[dict[str, int]], rounds: int = 3, pull: float = 200.0, lexicon: dict[str, int] | None = None):
        self.pieces = Pieces(raw)
        self.lexicon = lexicon or {}  # word -> languages it is known in, as bits
        vocabulary = sorted({w for c in counts for w in c})
        coded, owner = _parts(vocabulary)
        times = np.array([[c.get(w, 0) for c in counts] for w in vocabulary], float).reshape(len(vocabulary), len(counts))[owner]
        blocks = [(part, *self.pieces.lattice(ws)) for part, ws in _in_blocks(coded)]
        k = len(counts)
        seen = np.ones((self.pieces.count, k)) * 1e-3
        for part, _, found in blocks:  # start from how often each piece stands anywhere
            for ids in filter(lambda x: x is not None, found):
                w, j = np.nonzero(ids >= 0)
                np.add.at(seen, ids[w, j], times[part[w]] / 10)
        for _ in range(rounds):
            self.theta = self._normal(seen, pull)
            seen = np.zeros_like(seen)
            for part, lengths, found in blocks:
                alpha = forward(lengths, found, self.theta)
                n, width = alpha.shape[:2]
                beta = np.zeros_like(alpha)
                beta[np.arange(n), lengths] = 1.0
                total = np.maximum(alpha[np.arange(n), lengths], 1e-300)
                share = times[part] / total
                for j in range(width - 1, 0, -1):
                    for size in range(1, min(len(found), j) + 1):
                        if found[size - 1] is None:
                            continue
                        ids = found[size - 1][:, j]
                        w = np.flatnonzero(ids >= 0)
                        if len(w):
                            arc = self.theta[ids[w]] * beta[w, j]
                            np.add.at(seen, ids[w], alpha[w, j - size] * arc * share[w])
                            beta[w, j - size] += arc
        self.theta = self._normal(seen, pull)

    @staticmethod
    def _normal(seen: np.ndarray, pull: float) -> np.ndarray:
        pooled = seen.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        return (seen + pull * pooled[:, None]) / (seen.sum(axis=0) + pull)

    def scores(self, words: list[str], floor: float = -7.0) -> np.ndarray:
        """Log probability of each word in each language, relative to the best and not below ``floor``; words with digits are neutral."""
        out = np.zeros((len(words), self.theta.shape[1]), np.float32)
        spelled = [i for i, w in enumerate(words) if not any(c.isdigit() for c in w)]
        coded, owner = _parts([words[i] for i in spelled])
        total = np.zeros((len(spelled), self.theta.shape[1]))
        for part, ws in _in_blocks(coded):
            lengths, found = self.pieces.lattice(ws)
            np.add.at(total, owner[part], np.log(np.maximum(forward(lengths, found, self.theta)[np.arange(len(ws)), lengths], 1e-300)))
        if spelled:
            out[spelled] = np.maximum(total - total.max(axis=1, keepdims=True), floor)
        return out


class Scorer(dict):
    """word -> row of a score matrix; new words of a batch are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.matrix, self.new = model, np.zeros((0, len(LANGS)), np.float32), []
        self.bits = self.known = np.zeros(0, np.int16)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all words, end to end; offsets of the documents). ``known`` has for the same words the languages they are known in, as bits, -1 for words with digits."""
        if len(self) > CACHE:
            self.clear()
            self.matrix, self.bits = self.matrix[:0], self.bits[:0]
        rows = []
        for text in texts:
            found = WORD.findall(fold(text)) if text else []
            rows.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.new:
            self.matrix = np.concatenate([self.matrix, self.model.scores(self.new)])
            get = self.model.lexicon.get
            self.bits = np.concatenate([self.bits, np.array([-1 if any(c.isdigit() for c in w) else get(w, 0) for w in self.new], np.int16)])
            self.new = []
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.known = self.bits[flat]
        return self.matrix[flat], np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


SWITCH = 12.0  # cost of a change of language


def doubtful(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Documents whose best path may change its language: all others are sure to be one segment.

    A path with k changes beats the best single language only if its at most k + 1 stretches
    of other languages gain more than ``k * switch`` together, so one of them gains more than
    ``switch / 2``. That is looked for among all stretches, as the largest rise of the running
    sum of gains.
    """
    n = offsets[1:] - offsets[:-1]
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    main = (sums[offsets[1:]] - sums[offsets[:-1]]).argmax(axis=1)
    owner = np.repeat(np.arange(len(n)), n)
    if not len(owner):
        return np.empty(0, np.int64)
    gain = scores.astype(np.float64) - scores[np.arange(len(owner)), main[owner]][:, None]
    run = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(gain, axis=0)])
    # least running sum so far in the same document: each document is set below all before it
    step = 2 * (np.abs(run).max() + 1)
    low = np.minimum.accumulate(run[:-1] - (owner * step)[:, None], axis=0) + (owner * step)[:, None]
    return np.unique(owner[(run[1:] - low > switch / 2 - 1e-6).any(axis=1)])


def paths(scores: np.ndarray, offsets: np.ndarray, docs: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """Most probable language of each word of the documents given, all documents in step."""
    n = (offsets[1:] - offsets[:-1])[docs]
    order = np.argsort(-n, kind="stable")
    docs, n = docs[order], n[order]
    k = scores.shape[1]
    out: list = [None] * len(docs)
    group = 0
    while group < len(docs):  # documents of like length share a table
        size = max(1, min(len(docs) - group, 4_000_000 // max(1, int(n[group]) * k)))
        part, longest = np.arange(group, group + size), int(n[group])
        back = np.zeros((longest, size, k), np.bool_)
        best_of = np.zeros((longest, size), np.int8)
        state = np.zeros((size, k))
        live = size
        for t in range(longest):
            while live and n[part[live - 1]] <= t:
                live -= 1
            now = state[:live]
            if t:
                top = now.argmax(axis=1)
                peak = now[np.arange(live), top][:, None] - switch
                jump = now < peak
                back[t, :live], best_of[t, :live] = jump, top
                now = np.where(jump, peak, now)
            state[:live] = now + scores[offsets[docs[part[:live]]] + t]
        lang = state.argmax(axis=1)
        result = np.zeros((size, longest), np.int8)
        for t in range(longest - 1, -1, -1):
            on = n[part] > t
            result[on, t] = lang[on]
            jumps = on & back[t, np.arange(size), lang]
            lang = np.where(jumps, best_of[t], lang)
        for i in range(size):
            out[group + i] = result[i, : n[group + i]]
        group += size
    undo = np.empty(len(order), int)
    undo[order] = np.arange(len(order))
    return [out[i] for i in undo]


def segments_of(scorer: Scorer, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """(document, [(first word, end word, language, confidence)]) of each document with words; language -1 for a stretch without support."""
    scores, offsets = scorer.batch(texts)
    unsure = doubtful(scores, offsets)
    routes = dict(zip(unsure.tolist(), paths(scores, offsets, unsure), strict=True))
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    for d in range(len(texts)):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        if lo == hi:
            continue
        edges = [0, hi - lo]
        if d in routes:
            edges = [0, *(np.flatnonzero(np.diff(routes[d])) + 1).tolist(), hi - lo]
        found = []
        for a, b in zip(edges, edges[1:]):
            total = sums[lo + b] - sums[lo + a]
            lang = int(routes[d][a]) if d in routes else int(total.argmax())
            found.append((a, b, lang, float(1 / np.exp(np.minimum(total - total[lang], 50)).sum())))
        if len(found) > 1 and scorer.model.lexicon:
            backed = []
            for a, b, lang, _ in found:
                bits = scorer.known[lo + a : lo + b]
                words = bits >= 0
                backed.append(bool((words & (bits >> lang & 1 > 0)).sum() >= SUPPORT * words.sum() and words.any()))
            if any(backed):
                found = [x if ok else (x[0], x[1], -1, 0.0) for x, ok in zip(found, backed)]
        yield d, found


def fit(labelled: DataFrame, per_lang: int = 300, vocabulary: str = DEFAULT) -> Model:
    """Model from at most ``per_lang`` whole rows a language of ``labelled`` (text, code), collected to the driver."""
    good = labelled.where("code IS NOT NULL AND text IS NOT NULL").select("code", "text", F.xxhash64("text").alias("h"))
    # of each language about 8 * per_lang rows by hash, whatever its share of the table; all where there are no more
    found = {r.code: r.m for r in good.groupBy("code").agg(F.count("*").alias("m")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for code, m in found.items() for x in (code, min(1 << 40, (8 * per_lang << 40) // m))]), F.col("code")) if found else F.lit(0)
    few = good.where(F.pmod("h", F.lit(1 << 40)) < least)
    rows = few.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy("h", "text"))).where(F.col("k") <= per_lang).orderBy("code", "k").collect()
    raw = ranks_file(vocabulary)
    told = [(LANGS.index(r.code), WORD.findall(fold(r.text))) for r in rows]

    def counted(rows) -> list[dict[str, int]]:
        counts: list[dict[str, int]] = [{} for _ in LANGS]
        for lang, found in rows:
            for w in found:
                counts[lang][w] = counts[lang].get(w, 0) + 1
        return counts

    first = Scorer(Model(raw, counted(told), rounds=1))
    scores, offsets = first.batch([" ".join(found) for _, found in told])
    sums = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(scores, axis=0, dtype=np.float64)])
    main = (sums[offsets[1:]] - sums[offsets[:-1]]).argmax(axis=1)
    unsure = doubtful(scores, offsets)
    mixed = {int(d) for d, p in zip(unsure, paths(scores, offsets, unsure), strict=True) if len(set(p.tolist())) > 1}
    kept = [x for i, x in enumerate(told) if main[i] == x[0] and i not in mixed]
    rows_of: list[dict[str, int]] = [{} for _ in LANGS]
    for lang, found in kept:
        for w in set(found):
            rows_of[lang][w] = rows_of[lang].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for lang, seen in enumerate(rows_of):
        least = min(2, sum(1 for k, _ in kept if k == lang))
        for w, m in seen.items():
            if m >= least:
                lexicon[w] = lexicon.get(w, 0) | 1 << lang
    return Model(raw, counted(kept), lexicon=lexicon)


def detect(docs: DataFrame, model: Model, id_col: str = "id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, stored, seg, first_word, end_word, lang, confidence, n_words, main, main_confidence), one row per segment and distinct row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id string, stored string, seg int, first_word int, end_word int, lang string, confidence double, n_words int, main string, main_confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            ids, stored = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for d, found in segments_of(scorer, batch.column(2).to_pylist()):
                n = found[-1][1]
                size = np.zeros(len(LANGS))
                trust = np.zeros(len(LANGS))
                for a, b, lang, p in found:
                    if lang >= 0:
                        size[lang] += b - a
                        trust[lang] += p * (b - a)
                main = int(size.argmax())
                rows += [(ids[d], stored[d], s, a, b, LANGS[lang] if lang >= 0 else None, p, n, LANGS[main], float(trust[main] / n)) for s, (a, b, lang, p) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("string"), F.col(lang_col).cast("string"), F.col(text_col).cast("string")).where(F.length(text_col) > 0).mapInArrow(run, schema)


def label_issues(docs: DataFrame, model: Model, min_words: int = 20, stretch: int = 12, **cols) -> DataFrame:
    """(id, issue, lang): ``label`` for a missing or wrong stored language, ``mixed`` once per language with a long enough stretch."""
    rows = detect(docs, model, **cols).where(F.col("n_words") >= min_words)
    wrong = rows.where(F.col("seg") == 0).where(~F.col("main").eqNullSafe(label_code(F.col("stored")))).select("id", F.lit("label").alias("issue"), F.col("main").alias("lang"))
    # the first and later segments of a row leave the scan together: no shuffle but that of the few rows with long second stretches
    long_ = rows.where(F.col("lang").isNotNull() & (F.col("end_word") - F.col("first_word") >= stretch) & (F.col("n_words") > F.col("end_word") - F.col("first_word"))).select("id", "lang", F.xxhash64("id", "stored", "n_words").alias("row")).distinct()
    mixed = long_.withColumn("langs", F.count("*").over(W.partitionBy("row"))).where("langs > 1").select("id", F.lit("mixed").alias("issue"), "lang")
    return wrong.union(mixed).distinct()
