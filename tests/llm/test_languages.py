import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import languages as L
from millrace.llm.tokenizers import ranks_file

WORDS = {
    "en": "the and with many people say that near after before which because house river market old new law wedding".split(),
    "sv": "och med många säger att efter före vilket därför huset floden marknaden gammal ny lagen bröllopet kvarnen".split(),
    "vi": "và với nhiều người nói rằng sau trước bởi vì ngôi nhà dòng sông chợ luật mới lễ cưới".split(),
    "ar": "و مع كثير من الناس يقول إن بعد قبل لأن البيت النهر السوق القديم القانون الزواج".split(),
    "es": "y con muchos vecinos dicen que después antes porque la casa el río mercado viejo nuevo ley boda".split(),
    "fr": "et avec beaucoup de gens disent que après avant parce la maison le fleuve marché vieux nouveau loi mariage".split(),
    "de": "und mit viele leute sagen dass nach vor weil das haus der fluss markt alt neu gesetz hochzeit".split(),
}


def say(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(say(rng, lang, 40), lang) for lang in WORDS for _ in range(12)]
    rows += [(say(rng, "en", 40), "de"), (None, "en"), ("x", None)]
    return L.fit(spark.createDataFrame(rows, "text string, code string"))


def test_forward_sums_all_segmentations():
    pieces = L.Pieces(ranks_file())
    rng = np.random.default_rng(0)
    theta = rng.random((pieces.count, 2))
    word = "market".encode()
    lengths, found = pieces.lattice([word, b"a"])
    known = {word[i:j]: pieces.find(np.array([pieces._hash(word[i:j])], np.uint64))[0] for i in range(6) for j in range(i + 1, 7)}

    def total(rest: bytes, k: int) -> float:
        return 1.0 if not rest else sum(theta[known[rest[:n]], k] * total(rest[n:], k) for n in range(1, len(rest) + 1) if known.get(rest[:n], -1) >= 0)

    alpha = L.forward(lengths, found, theta)
    assert math.isclose(alpha[0, 6, 0], total(word, 0)) and math.isclose(alpha[0, 6, 1], total(word, 1))


def test_labels(spark):
    given = ["EN", " en ", "en_GB", "eng", "English", "vie", "AR-EG", "", None, "und", "multi", "xx", "en,sv", "fre"]
    want = ["en", "en", "en", "en", "en", "vi", "ar", None, None, None, None, None, None, "fr"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, l string").select("i", L.label_code(F.col("l")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == want


def test_issues(spark, model):
    rng = random.Random(2)
    rows = [(f"ok-{lang}", say(rng, lang, 40), lang) for lang in WORDS]
    rows += [("wrong", say(rng, "de", 30), "fr"), ("none", say(rng, "ar", 30), None), ("odd", say(rng, "es", 30), "??"), ("name", say(rng, "sv", 30), " Swedish")]
    rows += [("two", say(rng, "en", 40) + ". " + say(rng, "sv", 25) + ". " + say(rng, "en", 20), "en")]
    rows += [("quote", say(rng, "en", 40) + " " + say(rng, "vi", 5) + " " + say(rng, "en", 30), "en")]
    rows += [("short", say(rng, "de", 10), None), ("null", None, None), ("blank", " \n", "en"), ("digits", "1 2 3 " * 10, "en")]
    df = spark.createDataFrame([(i, t, l, 1) for i, t, l in rows + rows[-6:]], "id string, text string, lang string, seg int")
    got = [tuple(r) for r in L.label_issues(df, model).collect()]
    want = {("wrong", "label", "de"), ("none", "label", "ar"), ("odd", "label", "es"), ("two", "mixed", "en"), ("two", "mixed", "sv")}
    assert {g for g in got if g[0] != "digits"} == want and len(got) == len(set(got))
    seg = [r for r in L.detect(df, model).where("id = 'two'").distinct().collect()]
    assert [r.lang for r in sorted(seg, key=lambda r: r.seg)][:3] == ["en", "sv", "en"] and all(0 < r.confidence <= 1 for r in seg)


def test_paths_like_plain_viterbi():
    rng = np.random.default_rng(5)
    n = [1, 7, 30, 12, 30]
    offsets = np.concatenate([[0], np.cumsum(n)])
    scores = -rng.random((offsets[-1], 3)) * 9
    got = L.paths(scores, offsets, np.array([0, 2, 3, 4]), switch=6.0)
    for d, path in zip([0, 2, 3, 4], got):
        s = scores[offsets[d] : offsets[d + 1]]
        best = s[0]
        for row in s[1:]:
            best = row + np.maximum(best, best.max() - 6.0)
        own = sum(s[i, k] for i, k in enumerate(path)) - 6.0 * int((np.diff(path) != 0).sum())
        assert len(path) == n[d] and math.isclose(own, best.max())


def test_codes_and_names_have_no_language(spark, model):
    rng = random.Random(6)
    code = " ".join("".join(rng.choices("bdfghjklmnpqrstvwxz", k=rng.randint(20, 60))) for _ in range(40))
    rows = [("code", say(rng, "es", 40) + "\n" + code + "\n" + say(rng, "es", 30), "es"), ("digits", say(rng, "sv", 40) + " " + " ".join(f"a{k}b" for k in range(60)), "sv"), ("only", code, None)]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    assert {tuple(r) for r in L.label_issues(df, model).where("id <> 'only'").collect()} == set()
    found = L.detect(df, model).collect()
    assert {r.main for r in found if r.id == "code"} == {"es"} and all(r.main is not None for r in found)
    assert all(r.confidence == 0 for r in found if r.lang is None)


def test_only_documents_of_one_segment_are_not_doubtful():
    """A stretch that is long and weak, or short and strong, is looked for; what is not doubtful has a path without change."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 60, 400)
    offsets = np.concatenate([[0], np.cumsum(n)])
    liked = np.concatenate([np.repeat(rng.integers(0, 3, k // 12 + 1), 12)[:k] if k % 3 else np.zeros(k, int) for k in n])
    scores = -rng.random((offsets[-1], 3)).astype(np.float32) * np.where(np.arange(3)[None, :] == liked[:, None], 0.2, 3.0).astype(np.float32)
    found = set(L.doubtful(scores, offsets).tolist())
    split = {d for d, p in enumerate(L.paths(scores, offsets, np.arange(len(n)))) if len(set(p.tolist())) > 1}
    assert split and split <= found and len(found) < len(n)
    weak = np.zeros((400, 2), np.float32)
    weak[:200, 1], weak[200:, 0] = -0.2, -0.12  # no eight words differ by 6
    assert L.doubtful(weak, np.array([0, 400])).tolist() == [0] and len(set(L.paths(weak, np.array([0, 400]), np.array([0]))[0].tolist())) == 2


def test_all_pieces_count():
    pieces = L.Pieces(ranks_file())
    assert pieces.longest > 12
    lengths, found = pieces.lattice([b"a" * pieces.longest])
    assert len(found) == pieces.longest


def test_a_rare_language_is_fitted_from_all_its_rows(spark):
    rng = random.Random(4)
    rows = [(say(rng, "en", 30) + str(k), "en") for k in range(6000)] + [(say(rng, "sv", 30) + str(k), "sv") for k in range(6)]
    m = L.fit(spark.createDataFrame(rows, "text string, code string"), per_lang=20)
    assert m.scores(["kvarnen", "bröllopet"])[:, L.LANGS.index("sv")].tolist() == [0.0, 0.0]


def test_empty(spark, model):
    empty = spark.createDataFrame([], "id string, text string, lang string")
    assert L.label_issues(empty, model).count() == 0
    L.fit(spark.createDataFrame([], "text string, code string"))


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    rows = [(f"{lang}{k}", say(rng, lang, 25), lang) for lang in WORDS for k in range(20)]
    found = L.detect(spark.createDataFrame(rows, "id string, text string, lang string"), model).select("id", "stored", "main").distinct().collect()
    assert sum(r.main == r.stored for r in found) / len(rows) >= 0.98


def test_every_byte_of_a_long_word_counts(model):
    heads = ["och" * 22 + "x", "và" * 23]
    words = [h + t for h in heads for t in ("", "because" * 30, "wedding" * 9, "القديم" * 12)]
    logs = []
    for w in words:
        b = w.encode()
        parts = [b[k : k + 64] for k in range(0, len(b), 64)]
        lengths, found = model.pieces.lattice(parts)
        logs.append(np.log(np.maximum(L.forward(lengths, found, model.theta)[np.arange(len(parts)), lengths], 1e-300)).sum(axis=0))
    want = np.array(logs) - np.max(logs, axis=1, keepdims=True)
    got = model.scores(words, floor=-1e9)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert len({tuple(np.round(x, 3)) for x in got[:4]}) == 4 == len({tuple(np.round(x, 3)) for x in got[4:]})
