import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import consortium as K
from millrace.operators import contamination as C
from millrace.operators import corpus as O
from millrace.operators import relational as R
from millrace.operators import stats as S
from millrace.functions import numbers as N
from millrace.functions import text as X


def test_pending_and_deficit(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "k int, a string")
    assert {r.k for r in R.pending(q, done, ["k"], "a").collect()} == {2, 3}
    t = spark.createDataFrame([("a", 3), ("b", 1)], "s string, n int")
    have = spark.createDataFrame([("a",), ("b",), ("b",)], "s string")
    assert {r.s: r.need for r in R.deficit(t, have, "s", "n").collect()} == {"a": 2, "b": 0}


def test_override_union_last_wins(spark):
    a = spark.createDataFrame([("q", 1, "old"), ("q", 2, "newer")], "k string, seq int, v string")
    b = spark.createDataFrame([("q", 0, "val")], "k string, seq int, v string")
    assert R.override_union([a, b], ["k"], [F.col("seq")]).first().v == "val"
    assert R.override_union([b, a], ["k"], [F.col("seq")]).first().v == "newer"


def test_running_budget_like_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("ab"), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, n int").withColumn("h", X.seeded_order("1", F.col("k"), F.col("i")))
    order = {r.i: r.h for r in df.collect()}
    for crossing in (True, False):
        want = set()
        for k in ("hot", "a", "b"):
            total = 0
            for j, (_, i, n) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: order[r[1]])):
                if (total < 100) if crossing else (total + n <= 100 or total + n == n):
                    want.add(i)
                total += n
        assert {r.i for r in R.running_budget(df, "k", "n", "h", F.lit(100), crossing).collect()} == want


def test_zip_join_prefers_right(spark):
    l = spark.createDataFrame([(0, "x", "l"), (1, "y", "l")], "i int, q string, s string")
    r = spark.createDataFrame([(0, "r"), (1, None)], "i int, s string")
    assert sorted(map(tuple, R.zip_join(l, r, "i").collect())) == [(0, "x", "r"), (1, "y", "l")]


def plain_weights(scores, floor, cap):
    left = {k: v for k, v in scores.items() if v >= floor and v > 0}
    out, mass = {}, 1.0
    while left:
        total = sum(left.values())
        over = [k for k, v in left.items() if v / total * mass > cap]
        if not over:
            out |= {k: v / total * mass for k, v in left.items()}
            break
        for k in over:
            out[k] = cap
            mass -= cap
            del left[k]
    s = sum(out.values())
    return {k: v / s for k, v in out.items()}


@pytest.mark.parametrize("cap", [0.15, 0.3, 0.5, 0.6, 1.0])
def test_contribution_weights_like_repeated_capping(spark, cap):
    rng = random.Random(cap)
    cases = {g: {f"n{i}": round(rng.random() ** 3 * 10, 3) for i in range(rng.randint(1, 9))} for g in range(12)}
    cases[90], cases[91] = {"strong": 0.95, "dominant": 5.0, "weak": 0.4}, {"dominant": 10.0, "peer_a": 1.0, "peer_b": 1.0}
    df = spark.createDataFrame([(g, n, v) for g, c in cases.items() for n, v in c.items()] + [(99, "x", float("nan"))], "g int, n string, v double")
    got = {}
    for r in K.contribution_weights(df, ["g"], "n", "v", 0.5, cap).collect():
        got.setdefault(r.g, {})[r.n] = r.weight
    for g, c in cases.items():
        want = plain_weights(c, 0.5, cap)
        assert got.get(g, {}).keys() == want.keys()
        assert all(abs(got[g][n] - w) < 1e-9 for n, w in want.items())


def test_weighted_average_exact(spark):
    v = spark.createDataFrame([("strong", "w", 0, 2.0), ("dominant", "w", 0, 10.0)], "node string, tensor string, idx int, value double")
    w = spark.createDataFrame([("strong", 0.25), ("dominant", 0.75)], "node string, weight double")
    assert K.weighted_average(v, w, "node", ["tensor", "idx"], "value").first().average == 8.0


def test_merge_diagnostics_extremes(spark):
    cells = [(i, 0.0) for i in range(4)]
    start = spark.createDataFrame(cells, "idx int, value double")
    up = [(n, i, 1.0 if i % 2 == 0 else -1.0) for n in "ab" for i in range(4)]
    down = [(n, i, v if n == "a" else -v) for n, i, v in up]
    for rows, want in ((up, (1.0, 1.0, 1.0)), (down, (-1.0, 0.0, 0.0))):
        forks = spark.createDataFrame(rows, "node string, idx int, value double")
        assert tuple(K.merge_diagnostics(start, forks, "node", ["idx"], "value").first()) == pytest.approx(want)


def test_window_leaks_like_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(4, 12)))) for i in range(12)]
    docs = []
    for d in range(40):
        w = rng.choices(vocab, k=30)
        if d % 2:
            item = items[d % 12][1].split()
            w[5 : 5 + len(item)] = [x if rng.random() < 0.8 else "zz" for x in item]
        docs.append((f"d{d}", " ".join(w)))
    docs += [("null", None), ("empty", "")]
    want = {}
    for d, t in docs:
        w = (t or "").split()
        for i, p in items:
            p = p.split()
            best = max((len(set(p) & set(w[k : k + len(p)])) / len(set(p) | set(w[k : k + len(p)])) for k in range(len(w) - len(p) + 1)), default=0)
            if best >= 0.6:
                want[d, i] = round(best, 3)
    got = C.window_leaks(spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(items, "item_id int, text string"), "id", "item_id")
    assert {(r.id, r.item_id): r.jaccard for r in got.collect()} == pytest.approx(want)


def test_substring_may_end_inside_words(spark):
    docs = spark.createDataFrame([("a", "xx one two three four five six sevenfold"), ("b", "one two")], "id string, text string")
    items = spark.createDataFrame([(1, "x one two three four five six seven"), (2, "one two"), (3, None)], "item_id int, text string")
    got = {(r.id, r.item_id) for r in C.substring_leaks(docs, items, "id", "item_id").collect()}
    assert got == {("a", 1), ("a", 2), ("b", 2)}


def test_statistics_conventions(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    row = df.agg(N.mean0(F.col("v")).alias("m"), N.std0(F.col("v")).alias("s")).first()
    assert (row.m, row.s) == (1.0, 0.0)
    z = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "m double, s double").select(N.zscore(F.col("m"), F.col("s")).alias("z"))
    assert [r.z for r in z.collect()] == [float("inf"), float("-inf"), 0.0, 0.5]
    k = S.cohen_kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1)], "x int, y int"), "x", "y").first()
    assert k.kappa == 0.0


def test_controls(spark):
    df = spark.createDataFrame([("d", "", "s", "MIT", None)], "id string, text string, source string, license string, lang string")
    assert df.select(O.missing_fields(df).alias("m")).first().m == ["text", "lang"]
    with pytest.raises(O.CorpusError):
        O.assert_valid(df, "arm")
    out = O.balanced_lengths({"a": {"x": 200, "y": 30}, "b": {"z": 60}}, 0.2)
    assert abs(1 - sum(out["a"].values()) / 60) <= 0.2 or max(out["a"].values()) <= 20
