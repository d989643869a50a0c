import random

from millrace.llm.leaks import aligned, best_window, gram_hashes, codes_of, leaks
from millrace.llm.words import words


def made(seed=3):
    rng = random.Random(seed)
    vocab = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'en', 'ora', 'isk'])}" for _ in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(14, 50)))) for k in range(25)] + [(90, None), (91, ""), (92, "of it"), (0, None)]
    docs = []
    for d in range(90):
        w = rng.choices(vocab, k=rng.randint(40, 200))
        if d % 3 == 0:
            w[20:20] = words(rng.choice(items[:25])[1])
        elif d % 3 == 1:
            part = words(rng.choice(items[:25])[1])
            for _ in range(max(1, len(part) // 9)):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            part.insert(4, "7")
            w[10:10] = part
        docs.append((f"d{d}", ", ".join(w) + "."))
    docs += [("none", None), ("empty", ""), ("short", "of it"), docs[0], ("long", " ".join(rng.choices(vocab, k=3000)) + " " + items[3][1])]
    return [(i, t, 1, "x") for i, t in docs], items


def brute(docs, items, run=13, share=0.7):
    out = set()
    for i, t, *_ in docs:
        w = words(t)
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for k, p in items:
            p = words(p)
            if p and (any(tuple(p[j : j + run]) in grams for j in range(len(p) - run + 1)) or (len(w) >= len(p) and best_window(w, len(p), set(p)) >= share)):
                out.add((i, k))
    return out


def test_like_brute_force(spark):
    docs, items = made()
    got = leaks(spark.createDataFrame(docs, "id string, text string, item_id int, b string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) > 40 and {tuple(r) for r in got.collect()} == want


def test_fragments_from_inside_items_wherever_they_lie(spark):
    _, items = made(7)
    rng = random.Random(8)
    filler = [" ".join(f"z{rng.randrange(900)}q" for _ in range(n)) for n in (60, 3, 1, 80)]
    docs = [("f0", filler[0])]
    for k, text in items[:25]:
        w = words(text)
        if len(w) >= 30:
            docs += [(f"part{k}", " ".join(w[8:22])), (f"a{k}", filler[1]), (f"b{k}", filler[2]), (f"ends{k}", filler[3])]
    frame = spark.createDataFrame(docs, "id string, text string").coalesce(1)
    got = {tuple(r) for r in leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 8 and got == want


def test_blocks_of_items_give_the_same(spark):
    docs, items = made(5)
    d, e = spark.createDataFrame(docs, "id string, text string, item_id int, b string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks(d, e, block_chars=700).collect()} == {tuple(r) for r in leaks(d, e).collect()}


def test_empty(spark):
    docs, items = made()
    d, e = spark.createDataFrame(docs, "id string, text string, item_id int, b string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0


def test_gram_hash_depends_on_its_characters_only():
    h = gram_hashes(codes_of("xxthe quick brownyythe quick brown"))
    assert h[2] == h[19] and len(set(h.tolist())) > 15 and len(gram_hashes(codes_of("short"))) == 0


def masks(item):
    out = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def plain_alignment(a, b, shift, band):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and abs(j - shift - i) <= band else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment():
    assert aligned(masks("a b c d".split()), 4, "a x c d".split(), 0, 2) == 3 and aligned({}, 0, ["a"], 0, 1) == 0
    assert aligned(masks(["a"]), 1, ["x", "x", "x", "a"], 0, 1) == 0 and aligned(masks(["a"]), 1, ["x", "x", "x", "a"], 3, 0) == 1
    rng = random.Random(1)
    for _ in range(300):
        a, b = ["".join(rng.choices("abcd", k=1)) for _ in range(rng.randint(1, 12))], ["".join(rng.choices("abcd", k=1)) for _ in range(rng.randint(1, 15))]
        shift, band = rng.randint(-3, 5), rng.randint(0, 4)
        got, most = aligned(masks(a), len(a), b, shift, band), plain_alignment(a, b, shift, 99)
        assert plain_alignment(a, b, shift, band) == got <= most


def test_any_order_and_repeated_words(spark):
    """The rule counts distinct words: shuffled blocks, shuffled words and repeated words are found as brute force finds them."""
    rng = random.Random(11)
    vocab = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'en', 'ora', 'isk'])}{k % 7}" for k in range(900)]
    items, docs = [], []
    for k in range(120):
        w = rng.sample(vocab, 24) if k % 3 else rng.choices(rng.sample(vocab, 10), k=24)
        items.append((k, " ".join(w)))
        blocks = [w[i : i + 4] for i in range(0, 24, 4)]
        rng.shuffle(blocks)
        placed = [x for b in blocks for x in b] if k % 2 else rng.sample(w, 24)
        if k % 5 == 0:
            for j in rng.sample(range(24), 4):
                placed[j] = rng.choice(vocab)
        docs.append((f"d{k}", " ".join(rng.choices(vocab, k=rng.randint(0, 80)) + placed + rng.choices(vocab, k=rng.randint(0, 80)))))
    items += [(200, "one two three"), (201, "ab"), (202, "a b a b a b")]
    docs += [("few", "three one two"), ("ab", "x ab y"), ("rep", "b a a b b b")]
    got = leaks(spark.createDataFrame(docs, "id string, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) > 110 and {tuple(r) for r in got.collect()} == want
