"""Queries over all rows, rounds and words, held against plain code on small tables."""

import hashlib
import math
import re
from collections import defaultdict
from itertools import combinations

from millrace.plans import catalog
from millrace.plans.texts import MARKERS, MARKS


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return catalog.QUERIES[name](spark, str(folder)).collect()


WEIGHTS = "node string, round_num int, tensor string, idx int, value double, is_float boolean"


def weights():
    rows = [(n, r, t, i, math.sin(7 * r + 3 * i + ord(n) * (1 + len(t))), True) for r in (1, 2, 3, 4, 7) for n in "abc" for t in ("w", "bias") for i in range(4)]
    return [x for x in rows if x[:2] not in (("b", 2), ("b", 4), ("c", 4)) and x[:4] != ("a", 3, "w", 0)]


def test_delta_norms_of_every_round(spark, tmp_path):
    cells = {(r, n, t, i): v for n, r, t, i, v, _ in weights()}
    want = defaultdict(lambda: [None, 0])
    for r in (2, 3, 4):
        for n, t, i in {k[1:] for k in cells if k[0] in (r - 1, r)}:
            b, a = cells.get((r - 1, n, t, i)), cells.get((r, n, t, i))
            now = want[r, n, t]
            if a is None or b is None:
                now[1] += 1
            else:
                now[0] = (now[0] or 0) + (a - b) ** 2
    got = {(x.round_num, x.node, x.tensor): (x.norm, x.unmatched) for x in run(spark, tmp_path, "a22_delta_norm", "node_weights", weights(), WEIGHTS)}
    assert got == {k: (s and round(math.sqrt(s), 6), u) for k, (s, u) in want.items()}


def test_merge_diagnostics_of_every_round(spark, tmp_path):
    got = {x.round_num: x for x in run(spark, tmp_path, "a23_merge_diagnostics", "node_weights", weights(), WEIGHTS)}
    assert got.keys() == {2, 3, 4}
    cells = {(r, n, t, i): v for n, r, t, i, v, _ in weights()}
    for r, x in got.items():
        before = defaultdict(list)
        for (k, _, t, i), v in cells.items():
            if k == r - 1:
                before[t, i].append(v)
        d = defaultdict(dict)
        for (k, n, t, i), v in cells.items():
            if k == r and (t, i) in before:
                d[n][t, i] = v - sum(before[t, i]) / len(before[t, i])
        dot = lambda a, b: sum(v * d[b][k] for k, v in d[a].items() if k in d[b])
        cosines = [dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for a, b in combinations(d, 2)]
        keys = {k for v in d.values() for k in v}
        total = [sum(v.get(k, 0) for v in d.values()) / len(d) for k in keys]
        signs = [abs(sum(math.copysign(1, v[k]) for v in d.values() if k in v)) / len(d) for k in keys]
        norm = sum(math.sqrt(dot(n, n)) for n in d) / len(d)
        want = (sum(cosines) / len(cosines) if cosines else 0, sum(signs) / len(signs), math.sqrt(sum(v * v for v in total)) / norm)
        assert all(abs(a - b) < 2e-6 for a, b in zip((x.mean_cosine, x.sign_agreement, x.retained), want, strict=True))


def test_cue_score_of_texts_with_combining_marks(spark, tmp_path):
    texts = ["The village och the sea", "Da\u0303 the\u0301 village", "đã Đã đa\u0303 của cu\u0309a", "a\u030ao\u0308 åäö OCH", "\u0627\u0644\u0652\u0642\u064e the\u064e", "\u0301the och_the", "the,the", "", None]
    got = {x.id: x.cues for x in run(spark, tmp_path, "f19_cue_score", "grounded", [(str(i), 1, t) for i, t in enumerate(texts)], "id string, batch_no int, text string")}
    score = lambda t: 2 * len(re.findall(rf"\b({'|'.join(MARKERS)})\b", t, re.I)) + len(re.findall(f"[{MARKS}]", t, re.I))
    assert got == {str(i): None if t is None else score(t) for i, t in enumerate(texts)}


def test_survey_numbers_of_long_runs_of_digits(spark, tmp_path):
    texts = ["call 0123456789 or 7", "1234567890123456789012 then 3", "-99999999999 4 2", "0000000000001 and 00000000000000000003", "A 2, 4", "3 11111111111 1", "none"]

    def first(t):
        return next((v for v in map(int, re.findall(r"-?\d+", t)) if 1 <= v <= 10), None)

    def choices(t):
        n = [int(x) for x in re.findall(r"\d+", t)]
        return None if len(n) < 2 else {frozenset((1, 3)): 1, frozenset((2, 4)): 3}.get(frozenset(n[:2]), 2)

    got = {x.doc_id: (x.first_int, x.choices) for x in run(spark, tmp_path, "f29_survey_numbers", "documents", list(enumerate(texts)), "doc_id long, text string")}
    assert got == {i: (first(t), choices(t)) for i, t in enumerate(texts)}


def test_byte_tokens_of_every_language(spark, tmp_path):
    rows = [(0, "en", "plain"), (1, "vi", "đã của"), (2, "ar", "\u0645\u064e"), (3, None, "😀 a\n"), (4, "sv", ""), (5, "sv", None)]
    got = {x.item_id: (x.n_bytes, x.bytes) for x in run(spark, tmp_path, "f37_byte_tokens", "eval_items", rows, "item_id long, lang string, text string")}
    assert got == {i: (None, None) if t is None else (len(t.encode()), t.encode().hex().upper()) for i, _, t in rows}


def test_padding_to_the_longest_item(spark, tmp_path):
    lengths = [("en", 3), ("en", 55), ("en", 41), ("vi", 90), ("sv", 2), ("sv", 40)]
    rows = [(i, lang, " ".join(["ab"] * n)) for i, (lang, n) in enumerate(lengths)]
    got = {x.lang: (x.rows, x.shifted_tokens, x.pads) for x in run(spark, tmp_path, "f38_pad_and_shift", "eval_items", rows, "item_id long, lang string, text string")}
    of = {lang: [n for k, n in lengths if k == lang] for lang, _ in lengths}
    assert got == {lang: (len(ns), len(ns) * (max(ns) - 1), sum(max(ns) - n for n in ns)) for lang, ns in of.items()}


def test_texts_that_fit_the_window_are_kept(spark, tmp_path):
    sizes = [0, 1, 63, 64, 65, 66, 200]
    texts = [" ".join(f"w{k}" for k in range(n)) for n in sizes]
    got = {x.doc_id: (x.digest, x.kept) for x in run(spark, tmp_path, "f24_token_window", "documents", list(enumerate(texts)), "doc_id long, text string")}
    cut = lambda w: w if len(w) <= 65 else w[:32] + w[-33:]
    assert got == {i: (hashlib.md5(" ".join(cut(t.split())).encode()).hexdigest(), min(n, 65)) for i, (n, t) in enumerate(zip(sizes, texts, strict=True))}
