import random
import re

from millrace.llm.splitting import oversized, pieces

EDGE = re.compile(r"[\n\r\x0b\f\x85\u2028\u2029]|(?<=[.!?؟…])\s")


def made(seed=1):
    rng = random.Random(seed)
    rows = [("none", None), ("empty", ""), ("fits", "x" * 100), ("blob", "x" * 735), ("exact", "y" * 99 + ".\n" + "z" * 40), ("breaks", "\n" * 350), ("spaces", ". " * 200)]
    for d in range(40):
        parts = []
        for _ in range(rng.randint(1, 60)):
            parts.append("é" * rng.choice([1, 5, 20, 60, 99, 100, 101, 130, 250]) + rng.choice([". ", "! ", "\n", "\r\n", "؟ ", "… ", " ", ".\n\n"]))
        rows.append((f"d{d}", "".join(parts)))
    return rows + [rows[-1], ("d0", rows[8][1] + "tail.")]


def test_pieces_rejoin_within_the_limit(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "id string, text string, pos int")
    texts = {}
    for i, t in set(rows):
        texts.setdefault(i, set()).add(t)
    by = {}
    for r in pieces(df, 100, 20).collect():
        by.setdefault((r.id, r.version), []).append(r)
    back = {}
    for (i, _), found in by.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert all(len(r.text) <= 100 and r.overlap <= 20 and r.end > r.start or r.text == "" for r in found)
        t = "".join(r.text[r.overlap :] for r in found)
        assert all(r.text == t[r.start : r.end] for r in found)
        marks = {0, len(t)} | {m.start() for m in EDGE.finditer(t)} | {m.end() for m in EDGE.finditer(t)}
        assert all(r.forced == (r.end not in marks) for r in found)
        # a cut goes as far as a natural boundary allows
        for a, b in zip(found, found[1:]):
            assert not b.forced or not any(a.end < m <= a.end + 80 for m in marks)
            if not b.forced:
                assert not any(b.end < m <= a.end + 80 for m in marks)
        back.setdefault(i, set()).add(t)
    assert back == {i: t for i, t in texts.items() if t != {None}}


def test_oversized_like_the_rule(spark):
    rows = made(2)
    want = {}
    for i, t in rows:
        if t and len(t) > 100:
            at = [-1, *(m.start() for m in EDGE.finditer(t)), len(t)]
            forced = any(y - x - 1 > 100 for x, y in zip(at, at[1:]))
            want[i] = "forced" if forced or want.get(i) == "forced" else "natural"
    got = oversized(spark.createDataFrame(rows, "id string, text string"), 100, 20).collect()
    assert {r.id: r.cut for r in got} == want and len(got) == len(want)


def test_one_long_text(spark):
    t = "".join(f"Sentence number {i}. " for i in range(20_000))
    got = sorted(pieces(spark.createDataFrame([("a", t)], "id string, text string")).collect(), key=lambda r: r.piece)
    assert "".join(r.text[r.overlap :] for r in got) == t and not any(r.forced for r in got) and all(len(r.text) <= 2000 for r in got)


def test_empty(spark):
    assert pieces(spark.createDataFrame([], "id string, text string")).count() == 0 and oversized(spark.createDataFrame([], "id string, text string")).count() == 0
