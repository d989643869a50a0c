import hashlib

from pyspark.sql import functions as F

from millrace.llm import sampling as S

SCHEMA = "id string, place string, batch int"


def plain(l, r, seed=17, rounds=8):
    for a, b in S.round_keys(seed, rounds):
        m = ((r & S.LOW) ^ a) * S.FACTORS[0] + ((r >> 30) ^ b) * S.FACTORS[1]
        assert m < 2**62
        l, r = r, (l ^ m ^ (m >> 31)) & S.MASK
    return l, r


def undone(l, r, seed=17, rounds=8):
    for a, b in reversed(S.round_keys(seed, rounds)):
        l, r = r, l
        m = ((r & S.LOW) ^ a) * S.FACTORS[0] + ((r >> 30) ^ b) * S.FACTORS[1]
        l = (l ^ m ^ (m >> 31)) & S.MASK
    return l, r


def ids(n):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    return [f"a:b:{digits[i // 46656 % 36]}{digits[i // 1296 % 36]}{digits[i // 36 % 36]}{digits[i % 36]}" for i in range(n)] + ["odd id", "UPPER:X!", ""]


def test_permutation_is_a_bijection_and_agrees(spark):
    numbers = [*range(3000), 2**61 + 5, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r.n: (r.p.l, r.p.r) for r in df.select("n", S.permuted(S.number_of(F.col("n"), True)).alias("p")).collect()}
    halves = {n: ((n % 2**64) >> 60, n & S.MASK) for n in numbers}
    assert got == {n: plain(*h) for n, h in halves.items()} and len(set(got.values())) == len(numbers)
    assert all(undone(*got[n]) == h for n, h in halves.items())
    assert all(0 <= x < S.SIDE for p in got.values() for x in p)


def test_the_whole_identifier_counts(spark):
    """Ids that end alike, or differ in leading zeros only, have numbers and places of their own."""
    names = ["a:law:03g5if", "b:civic:03g5if", "03g5if", "x:1", "x:01", "x:001", "", " "]
    df = spark.createDataFrame([(x,) for x in names + names] + [(None,)], "id string")
    got = {r.id: (r.n.l, r.n.r) for r in df.where("id IS NOT NULL").select("id", S.number_of(F.col("id")).alias("n")).collect()}
    assert len(set(got.values())) == len(names)
    assert S.collisions(df).count() == 0 and S.stable_sample(df, 1.0, check=True).count() == 2 * len(names)
    many = spark.range(50_000).select(F.concat(F.lit("s:"), F.col("id")).alias("id"))
    assert S.collisions(many).count() == 0 and many.select(S.place_of(F.col("id")).alias("p")).distinct().count() == 50_000
    assert abs(S.stable_sample(many, 0.25).count() / 50_000 - 0.25) < 0.01


def test_same_for_any_layout_and_kept_as_data_grow(spark):
    rows = [(i, None, k % 3) for k, i in enumerate(ids(4000))] + [(None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = {r.id for r in S.stable_sample(df, 0.1).collect()}
    assert {r.id for r in S.stable_sample(df.repartition(7).orderBy(F.desc("id")), 0.1).collect()} == chosen
    early = {r.id for r in S.stable_sample(df.where("batch < 2"), 0.1).collect()}
    assert early == {r.id for r in df.where("batch < 2").collect()} & chosen
    assert chosen <= {r.id for r in S.stable_sample(df, 0.2).collect()}
    assert abs(len(chosen) / 4000 - 0.1) < 0.02 and None not in chosen


def halves_of(name):
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:15], 16), int(h[15:30], 16)


def test_rates_and_repeats(spark):
    df = spark.createDataFrame([("a:b:00001", "x", 1)] * 3 + [(None, None, None)], SCHEMA)
    assert S.stable_sample(df, 0).count() == 0 and S.stable_sample(df, 1).count() == 3
    assert S.stable_sample(df.limit(0), 0.5).count() == 0
    assert {r.place for r in S.stable_sample(df, 1, place_col="place").collect()} == {plain(*halves_of("a:b:00001"))[0]}
