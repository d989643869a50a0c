import random

from pyspark.sql import functions as F

from millrace.llm import reading_level as R
from millrace.llm.prose import measure

PROSE = "The mill was old. It held the grain of the town. Many people saw it."


def stats(text):
    s, n, _, _ = measure(text)
    return s, n


def test_prose_only():
    base = stats(PROSE)
    assert base == (3, 15)
    for extra in (
        "# A heading\n\n", "== Notes\n\n", "- an entry here\n- another entry\n\n", "1. first thing to do\n\n", "| a | b |\n|---|---|\n| 1 | 2 |\n\n", "```\nx = call(y)\nz = 3\n```\n\n", "    k_1 = keep(v, lower=True)\n\n",
        "2024-01-02T03:04:00Z node round=3 state=ok\n\n", "License: CC-BY-4.0\n\n", "Contact: desk@a.example\n\n", "https://a.example/b/1\n\n", '{"id": "a-1", "q": 0.3}\n\n', "Sources\n\n", "id-4 | cards | ok\n\n",
    ):
        assert stats(extra + PROSE) == base, extra
        assert stats(PROSE + "\n\n" + extra) == base, extra
    assert stats("<p>" + PROSE.replace(". ", ".<br>\n") + "</p>") == base


def test_sentence_ends():
    assert stats("See e.g. Holm and cf. Art. 7 of vol. 3, ca. 40 pages. The price was 12.75 then. Was it No. 4?") == (3, 24)
    assert stats("He went home … and slept. She stayed!") == (2, 7)
    assert stats("") == stats(None) == (0, 0)


def test_wrapped_and_one_sentence_per_line():
    assert stats("The old mill by the river held\nthe grain of the town. Many\npeople saw it there.") == (2, 17)
    assert stats("The mill was old\nIt held the grain\nMany people saw it\nWe built the house?") == (4, 16)


def documents():
    rng = random.Random(4)
    easy, hard = "the cat saw a dog and it ran to us at home".split(), "administration constitution documentation jurisdiction nevertheless representative characteristic responsibility the of".split()
    rows = []
    for i in range(60):
        words, length, n = (easy, 5, 14) if i % 3 == 0 else (hard, 35, 4) if i % 3 == 1 else (easy + hard, 15, 6)
        text = " ".join(" ".join(rng.choices(words, k=length)).capitalize() + "." for _ in range(n))
        rows.append((i, text, "en" if i % 7 else None, 9.0))
    rows += [(100, rows[0][1], "en", 1.0), (101, None, "en", 1.0), (102, "", None, 1.0), (103, "# only a heading", "en", 1.0), (104, "short prose here.", "en", 1.0), rows[0]]
    return rows


def test_bands_and_levels(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, level double")
    norms = spark.createDataFrame([("en", 5.1), ("sv", None)], "lang string, typical_word_len double")
    levels = R.reading_levels(df, norms)
    graded = R.grades(levels, None)
    told = {r.doc_id: r.level for r in levels.collect()}
    assert told.keys() == {r[0] for r in rows} and told[101] is told[102] is told[103] is None
    mean = lambda k: sum(told[i] for i in range(60) if i % 3 == k) / 20
    assert mean(0) < mean(2) < mean(1)
    want = {(i, "easy") for i in range(0, 60, 3)} | {(i, "hard") for i in range(1, 60, 3)} | {(100, "easy")}
    got = R.bands(graded, norms).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    # the model decides: with one level for all documents no row is left on either side
    same = R.grades(levels.withColumn("level", F.when(F.col("level").isNotNull(), 0.0)), None)
    assert R.bands(same, norms).count() == 0
    labels = spark.createDataFrame([(1, i, "r", 3 if i % 3 == 0 else 12) for i in (0, 1, 3, 4)] + [(9, 5, "r", None)], "label_id long, doc_id long, reader string, grade int")
    g = {r.doc_id: r.grade for r in R.grades(levels, labels).collect()}
    assert g[0] < g[1] and all(1 <= x <= 16 for x in g.values() if x is not None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    norms = spark.createDataFrame([("en", 5.1)], "lang string, typical_word_len double")
    assert R.reading_levels(df, norms).count() == 0 and R.bands(R.grades(R.reading_levels(df, norms.limit(0)), None), norms).count() == 0


def test_sentences_do_not_enter_the_level(spark):
    """The same words in sentences of other lengths give the same level; grades tie the scale of unlabelled documents."""
    rng = random.Random(9)
    plain, learned = [f"ab{c}d" for c in "abcdefghijklmnop"], [f"xy{c}z" for c in "abcdefghijklmnop"]  # equally long words
    rows = []
    for i in range(80):
        words = rng.choices(plain if i % 2 else learned, k=60)
        rows.append((i, " ".join(w + ("." if k % (5 if i % 4 < 2 else 30) == 0 else "") for k, w in enumerate(words)), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    norms = spark.createDataFrame([("en", 4.0)], "lang string, typical_word_len double")
    labels = spark.createDataFrame([(i, "r", 3 if i % 2 else 13) for i in range(12)], "doc_id long, reader string, grade int")
    told = {r.doc_id: (r.level, r.grade) for r in R.grades(R.reading_levels(df, norms, labels), labels).collect()}
    assert max(told[i][0] for i in range(12, 80) if i % 2) < min(told[i][0] for i in range(12, 80) if not i % 2)
    assert all((told[i][1] < 8) == bool(i % 2) for i in range(12, 80))
    r = R.agreement(df, norms, labels).first()
    assert r.held > 0 and (r.correlation is None or r.correlation > 0.8)
