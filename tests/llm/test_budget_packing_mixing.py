import datetime
import random

import numpy as np
import pytest

from millrace.llm import mixing, packing
from millrace.llm.token_budget import TokenLedger
from millrace.llm.tokenizers import count_tokens, encoder, ranks_file

DELIVERED = "id string, text string, source string, lang string, domain string, batch_no int, fetched_at timestamp, tokens int"
T0 = datetime.datetime(2024, 1, 1)


def row(i, text, source="a-b", lang="en", domain="law", batch=0):
    return (i, text, source, lang, domain, batch, T0, 5)


def test_ledger_equals_a_fresh_count_and_encodes_once(spark):
    enc = encoder(ranks_file())
    first = [row("1", "one two three"), row("2", "four", "A_B", "English", "topic:law"), row("3", None, None, "??", ""), row("4", "", " a b "), row("5", "gone"), row(None, "x")]
    second = [row("1", "one two three", batch=1), row("2", "four five", batch=1), row("6", "one two three", "new", "sv", "Law", 1), row("6", "one two three", "new", "sv", "Law", 1)]
    ledger = TokenLedger(spark)
    ledger.update(spark.createDataFrame(first, DELIVERED))
    ledger.update(spark.createDataFrame(second, DELIVERED), removed=spark.createDataFrame([("5",), ("9",)], "id string"))
    want = {("a-b", "en", "law"): (3, count_tokens(enc, "one two three") + count_tokens(enc, "four five")), ("unknown", "unknown", "unknown"): (1, 0), ("new", "sv", "law"): (1, count_tokens(enc, "one two three"))}
    assert {(r.source, r.lang, r.domain): (r.docs, r.tokens) for r in ledger.cube().collect()} == want
    counts = ledger._known()
    assert counts.count() == counts.distinct().count() == 4  # each text once, though two were delivered again
    total = ledger.totals().where("source IS NULL AND lang IS NULL AND domain IS NULL").first()
    assert (total.docs, total.tokens) == (5, sum(t for _, t in want.values()))
    ledger.update(spark.createDataFrame(second, DELIVERED), complete=True)
    assert {r.id for r in ledger.document_tokens().collect()} == {"1", "2", "6"}
    ledger.update(spark.createDataFrame([], DELIVERED))
    assert sum(r.docs for r in ledger.cube().collect()) == 3


def test_ledger_goes_on_from_its_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    first = [row("1", "one two three"), row("2", "four five six"), row("3", "seven", batch=5), row("4", "four five six")]
    a = TokenLedger(spark, folder)
    a.update(spark.createDataFrame(first, DELIVERED))
    assert a.encoded == 3
    # what an interrupted update leaves is named in no manifest
    spark.createDataFrame([("x",)], "content string").write.parquet(f"{folder}/counts-unfinished")
    b = TokenLedger(spark, folder)
    assert sorted(b.cube().collect()) == sorted(a.cube().collect())
    b.update(spark.createDataFrame(first, DELIVERED))
    assert b.encoded == 0 and sorted(b.cube().collect()) == sorted(a.cube().collect())
    # an older delivery does not overwrite a newer one, a removed document comes back as it is delivered
    b.update(spark.createDataFrame([row("3", "eight nine", batch=2), row("5", "ten", batch=2)], DELIVERED), removed=spark.createDataFrame([("1",), ("1",), ("77",)], "id string"))
    c = TokenLedger(spark, folder)
    enc = encoder(ranks_file())
    told = lambda ledger: {r.id: r.n_tokens for r in ledger.document_tokens().collect()}
    assert told(c) == {"2": count_tokens(enc, "four five six"), "3": count_tokens(enc, "seven"), "4": count_tokens(enc, "four five six"), "5": count_tokens(enc, "ten")}
    c.update(spark.createDataFrame([row("1", "one two three", batch=0)], DELIVERED))
    assert c.encoded == 0 and "1" in told(c) and sum(r.docs for r in c.cube().collect()) == 5
    before = sorted(c.cube().collect()), told(c)
    c.compact()
    assert all(len(x) == 1 for x in c.tables.values()) and (sorted(c.cube().collect()), told(c)) == before
    d = TokenLedger(spark, folder)
    d.update(spark.createDataFrame([row("2", "changed text", batch=9)], DELIVERED), complete=True)
    assert told(d).keys() == {"2"} and [r.docs for r in d.cube().collect()] == [1]
    with pytest.raises(RuntimeError):  # the version was written by another update
        c.update(spark.createDataFrame(first, DELIVERED))
    with pytest.raises(ValueError):
        TokenLedger(spark, folder, "byte_bpe_50k")


def test_long_texts_are_counted_exactly():
    enc = encoder(ranks_file())
    rng = random.Random(1)
    for _ in range(3):
        t = "".join(rng.choice(["word ", "tall  ", "x\n", "é", "12 ", "'s ", ". "]) for _ in range(120_000))
        assert count_tokens(enc, t) == len(enc.encode_ordinary(t))
    assert count_tokens(enc, None) == count_tokens(enc, "") == 0


def test_packing_places_everything_once(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 3, 50, 90, 100, 101, 205, 400]) if rng.random() < 0.5 else rng.randint(1, 130)) for i in range(3000)] + [(9000, None), (None, 4), (5, 1)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    want = {}
    for i, n in sizes:
        if i is not None:
            want[i] = max(want.get(i, 0), n or 0)
    got = packing.pack(df, 100).collect()
    total, boxes = {}, {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r.tokens
        if r.container is None:
            assert r.tokens == 0
        else:
            boxes[r.container] = boxes.get(r.container, 0) + r.tokens
    assert total == want and max(boxes.values()) <= 100
    assert all(sum(1 for r in got if r.id == i) == 1 for i in list(want)[:200] if want[i] <= 100)
    assert sum(boxes.values()) / (100 * len(boxes)) > 0.97
    assert len({(r.id, r.part) for r in got}) == len(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    n = np.clip(rng.lognormal(5, 0.8, 6000).astype(int), 1, 1024)
    h = dict(zip(*(x.tolist() for x in np.unique(n, return_counts=True))))
    told = packing.plan(h, 1024)
    used = {}
    for config, copies in told.chosen:
        assert sum(k * a for k, a in config.items()) <= 1024
        for k, a in config.items():
            used[k] = used.get(k, 0) + a * copies
    boxes = sum(c for _, c in told.chosen)
    assert used == h and told.bound <= boxes <= 1.01 * told.bound + 2
    assert told.lp_items + told.mended_items == len(n) and told.lp_items > 0.85 * len(n) and told.lp_value <= 1.1 * told.bound


@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_configurations_of_the_lp_place_the_items(times):
    """More items of the same lengths: the rounding keeps more of the fractional cover, by the same rule."""
    n = np.clip(np.random.default_rng(5).lognormal(4, 0.7, 900).astype(int), 1, 256)
    h = {int(k): int(c) * times for k, c in zip(*np.unique(n, return_counts=True))}
    told = packing.plan(h, 256)
    assert told.lp_items + told.mended_items == len(n) * times and told.lp_items > (0.75 if times == 1 else 0.95) * len(n) * times
    assert sum(c for _, c in told.chosen) <= 1.02 * told.bound + 2


def test_plan_without_partners():
    """Lengths that leave no room for another, and ones that only round up beyond the grid."""
    assert sum(c for _, c in packing.plan({1020: 3, 1000: 2, 900: 1}, 1024).chosen) == 6
    assert sum(c for _, c in packing.plan({512: 5}, 1024).chosen) == 3 and packing.plan({}, 8).chosen == []


def test_usage_and_invariants(spark):
    docs = spark.createDataFrame([(i, "a word or two " * (i % 40)) for i in range(300)] + [(7, None), (900, "long " * 700)], "doc_id long, text string")
    r = packing.usage_report(docs, 128).first()
    assert r.fullest <= 128 and r.lp_items + r.mended_items <= r["items"] and r.bound <= r.containers
    got = packing.invariants(packing.pack_documents(docs, 128), 128).first()
    assert tuple(got) == (301, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 100, 0), (2, 0, 100, 0), (3, 0, 5, 1), (3, 0, 5, 1), (4, 0, 3, 2), (4, 1, 3, 2)], "doc_id long, part long, tokens long, container long")
    assert tuple(packing.invariants(bad, 128).first()) == (4, 1, 1, 2)


def test_pack_empty_and_texts(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0
    docs = spark.createDataFrame([(1, "a few words", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, container string")
    assert {r.doc_id: r.tokens for r in packing.pack_documents(docs, 16).collect()} == {1: 3, 2: 0, 3: 0}


def test_ranks_do_not_depend_on_hot_lengths(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else i % 5) for i in range(500)], "key long, length long")
    ranks = {}
    for r in packing.ranked(df, "length", "key", bucket_rows=40).collect():
        ranks.setdefault(r.length, []).append(r.rank)
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_water_fill():
    assert mixing.water_fill(10, [1, 1], [2, 100]) == [2, 8]
    assert mixing.water_fill(10, [1, 3], [100, 100]) == [2.5, 7.5]
    assert mixing.water_fill(10, [1, 1], [1, 2]) == [1, 2] and mixing.water_fill(5, [], []) == []


def test_shortage_goes_to_siblings_first():
    leaf = lambda d, l, s, w, cap: {"domain": d, "lang": l, "source": s, "weight": w, "cap": cap}
    got = mixing.budgets([leaf("law", "en", "a", 0.4, 10), leaf("law", "en", "b", 0.2, 90), leaf("law", "sv", "c", 0.2, 90), leaf("art", "en", "d", 0.2, 90)], 100)
    assert got == pytest.approx({("law", "en", "a"): 10, ("law", "en", "b"): 50, ("law", "sv", "c"): 20, ("art", "en", "d"): 20})


def mixed(spark, repeat=1):
    rng = random.Random(7)
    docs = []
    for i in range(600):
        s = "big" if i % 3 == 0 else rng.choice(["mid", "small", "Small ", "other"])
        docs.append((i, " ".join(["word"] * rng.randint(1, 40)), s, rng.choice(["en", "sv", None]), rng.choice(["law", "art", " Law"]), 3))
    docs += [(900, None, "big", "en", "law", 1), (901, "", "mid", None, None, 1), (None, "x", "big", "en", "law", 1)]
    targets = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 3), ("absent", 0.1, 4), ("odd", None, 1), ("nan", float("nan"), 2)]
    d = spark.createDataFrame(docs * repeat, "doc_id long, text string, source string, lang string, domain string, uses int")
    return d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix_shares_caps_and_layout(spark):
    d, t = mixed(spark)
    used, shares = mixing.mix(d, t, total_tokens=4000)
    rows, s = used.collect(), {r.source: r for r in shares.collect()}
    total = sum(r.n_tokens * r.uses for r in rows)
    assert abs(total - 4000) < 200 and set(s) == {"big", "mid", "small", "absent"}
    for name, share in (("big", 0.5), ("mid", 0.2), ("small", 0.2)):
        assert abs(s[name].actual_share - share / 0.9) < 0.04
    assert s["absent"].tokens == 0 and all(r.uses <= {"big": 1, "mid": 2, "small": 3}[r.source] for r in rows)
    again = mixing.mix(d.repartition(9), t, total_tokens=4000)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) and len({r.id for r in rows}) == len(rows)


def test_mix_uses_whole_epochs_when_more_is_asked_than_there_is(spark):
    d, t = mixed(spark, 2)  # repeated rows count once
    used, _ = mixing.mix(d, t, total_tokens=10**9)
    assert {(r.source, r.uses) for r in used.collect()} == {("big", 1), ("mid", 2), ("small", 3)}
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[1].count() == 0
