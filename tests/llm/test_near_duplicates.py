import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.llm import near_duplicates as nd
from millrace.llm.words import words

SCHEMA = "id string, text string, cls long, sig int"  # the last two clash with names used inside


def sets(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for c in range(14):
        base = rng.choices(vocab, k=rng.randint(30, 120))
        for v in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if v == 3:
                t.insert(10, "new")
            rows.append((f"c{c}v{v}", " ".join(t)))
    rows += [("copy1", rows[0][1].upper()), ("copy2", rows[0][1] + "!"), ("null", None), ("blank", " "), ("stub", "n/a"), rows[1]]
    return [(i, t, 7, 7) for i, t in rows]


def test_pairs_like_brute_force(spark):
    rows = corpus()
    texts = {i: t for i, t, *_ in rows if t and len(words(t)) >= 20}
    want = set()
    for a, b in combinations(sorted(texts), 2):
        x, y = sets(texts[a], 3), sets(texts[b], 3)
        if len(x & y) / len(x | y) >= 0.5:
            want.add((a, b))
    got = nd.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), shingle=3, threshold=0.5, min_words=20).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_groups_are_components_of_exact_links(spark):
    rows = corpus(2)
    texts = {i: t for i, t, *_ in rows if t and len(words(t)) >= 5}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets(texts[a], 5), sets(texts[b], 5)
        if x and len(x & y) / len(x | y) >= 0.8:
            root[find(b)] = find(a)
    got = {r.id: r.group_id for r in nd.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == texts.keys()
    for a, b in combinations(sorted(texts), 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


def test_every_id_has_a_group(spark):
    rows = [*corpus(2), ("stub2", "N/A!", 7, 7), ("null2", None, 7, 7), ("blank2", "", 7, 7), ("both", "n/a", 7, 7), ("both", corpus(2)[0][1], 7, 7), (None, "n/a", 7, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    long, found = ({r.id: r for r in nd.duplicate_groups(docs, every=every).collect()} for every in (False, True))
    assert found.keys() == {i for i, *_ in rows if i is not None}
    assert all(found[i] == r for i, r in long.items())
    short = [found[i].group_id for i in ("stub", "null", "null2", "blank", "blank2")]
    assert found["stub2"].group_id == short[0] and len(set(short)) == 5 and not set(short) & {r.group_id for r in long.values()}
    assert all(r.links == 0 for i, r in found.items() if i not in long)


def test_components_like_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(25)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in edges if a != b for x in (a, b)}}


def test_large_buckets_lose_nothing(spark):
    """Buckets far over the block size give the same pairs as one block would."""
    sig = spark.createDataFrame([(i, [1, 2, i % 3]) for i in range(50)], "cls long, sig array<long>")
    small, large = ({tuple(r) for r in nd.candidates(sig, block).collect()} for block in (4, 1000))
    assert small == large == set(combinations(range(50), 2))


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [("one", a), ("two", a), ("both", a), ("both", b), ("three", b), ("far", a.replace("a", "z"))]
    got = {r.id: r.group_id for r in nd.duplicate_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert len({got[i] for i in ("one", "two", "both", "three")}) == 1 and got["far"] != got["one"]
    pairs = nd.duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), shingle=3, threshold=0.5, min_words=20)
    assert {tuple(r) for r in pairs.collect()} == {("one", "two"), ("both", "one"), ("both", "two"), ("both", "three")}


def test_copies_are_signed_once_a_task_and_keep_their_group(spark):
    """A hundred thousand copies are a handful of signatures; texts near them are still found."""
    base = " ".join(f"w{i}" for i in range(30))
    near = base.replace("w29", "other")
    copies = spark.range(100_000, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.lit(base).alias("text"))
    docs = copies.union(spark.createDataFrame([("near", near), ("apart", near.replace("w", "q"))], "id string, text string"))
    told = nd.signed(docs)
    assert told.count() == 100_002 and told.where(F.size("sig") > 0).count() <= 4 + 2 * docs.rdd.getNumPartitions()
    groups = nd.duplicate_groups(docs)
    sizes = {r.group_id: (r["count"], r.links) for r in groups.groupBy("group_id").agg(F.count("*").alias("count"), F.max("links").alias("links")).collect()}
    assert sorted(sizes.values()) == [(1, 0), (100_001, 1)]


def test_hot_keys_are_spread_and_lose_nothing(spark):
    """One band key held by all classes, and a hub in the star rounds."""
    sig = spark.range(3000).select(F.col("id").alias("cls"), F.array(F.lit(1), F.col("id") % 1500 + 10).alias("sig"))
    assert nd.hot_keys(sig.select("cls", F.posexplode("sig").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "cls")).count() == 1
    assert nd.candidates(sig).count() == 3000 * 2999 // 2
    hub = spark.range(1, 30_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert nd.components(hub).select("root").distinct().count() == 1


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert nd.duplicate_pairs(empty).count() == 0 and nd.duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_signatures_estimate_similarity(share):
    import numpy as np

    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**32, int(1000 * share)), rng.integers(0, 2**32, (2, int(1000 * (1 - share) / 2)))
    a, b = nd.hash_family(400, 3)
    x, y = (nd.minima(np.unique(np.concatenate([common, o])).astype(np.uint32), a, b) for o in own)
    assert abs((x == y).mean() - share) < 0.1
