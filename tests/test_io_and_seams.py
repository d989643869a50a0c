import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import contamination as C
from millrace.operators import relational as J
from millrace.operators import packing as P
from millrace.operators import seams
from millrace.operators.corpus import CorpusError
from millrace.sources import extractors as E
from millrace.sources import readers as R
from millrace.sources import writers as W
from millrace.streaming import incremental as I


def test_json_tolerances(spark, tmp_path):
    doc = {"id": "a", "text": "t é", "source": "s", "license": "MIT", "lang": "en"}
    good, bad, empty = tmp_path / "g.json", tmp_path / "b.json", tmp_path / "e.json"
    good.write_text(json.dumps(doc) + "\n")
    bad.write_text(json.dumps(doc) + '\n{"id": "b", "te')
    empty.write_text("")
    assert R.json_strict(spark, str(good)).first().text == "t é"
    assert R.json_lenient(spark, str(bad), R.DOCUMENT).count() == 1 and R.json_lenient(spark, str(tmp_path / "none"), "a string").count() == 0
    with pytest.raises(CorpusError):
        R.json_strict(spark, str(empty))
    with pytest.raises(Exception):
        R.json_plain(spark, str(bad), R.DOCUMENT).collect()
    good.write_text(json.dumps(doc | {"text": ""}) + "\n")
    with pytest.raises(CorpusError):
        R.json_strict(spark, str(good))


def test_nested_files(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"culture": "c", "language": "en", "arms": {"grounded": {"file": "g", "lang": "en", "min_year": 1990}}}))
    row = R.manifest(spark, str(m)).first()
    assert (row.arm, row.min_year, row.token_ratio_tolerance, row.require_same_language) == ("grounded", 1990, 0.2, True)
    s = tmp_path / "s.json"
    topic = {"topic_id": "T1", "topic_description": "d", "scenarios": [{"scenario_id": "S1", "scenario_description": "x", "volume": 3}]}
    s.write_text(json.dumps({"topics": [topic], "part_2_b": [topic]}))
    assert sorted((r.part or "", r.scenario_id, r.volume) for r in R.scenarios(spark, str(s)).collect()) == [("", "S1", 3), ("part_2", "S1", 3)]
    x = tmp_path / "x.json"
    x.write_text(json.dumps({"A": [1.0, 2.0]}))
    assert tuple(R.coordinates(spark, str(x)).first()) == ("A", 1.0, 2.0)
    for k in (2, 10):
        (tmp_path / f"seed_{k}.json").write_text(json.dumps({"v": k}))
    assert sorted((r.k, r.v) for r in R.numbered(spark, str(tmp_path), "seed_", "v int").collect()) == [(2, 2), (10, 10)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "i int, k string, t string")
    out = str(tmp_path / "p")
    W.partitioned(df, out, ["k"], "parquet")
    W.partitioned(df.where("k = 'b'").withColumn("t", F.lit("z")), out, ["k"], "parquet")
    assert sorted((r.k, r.t) for r in spark.read.parquet(out).collect()) == [("a", "x"), ("b", "z")]
    target = str(tmp_path / "r")
    assert W.replace(df, target) is None
    kept = W.replace(df.limit(1), target, backup=True)
    assert spark.read.parquet(target).count() == 1 and spark.read.parquet(kept).count() == 2
    rounds = str(tmp_path / "rounds")
    for k in (0, 1, 3):
        W.write_round(df, rounds, k)
    assert W.finished_rounds(spark, rounds) == 2
    assert W.markdown(df, ["i", "k"]).splitlines()[0] == "i | k"
    m = W.manifest_json(spark.createDataFrame([("g", "en", "law"), ("g", "en", "art")], "arm string, lang string, domain string"), "c").first().value
    assert json.loads(m)["arms"]["g"]["domains"] == ["art", "law"]


def test_extractors(spark):
    mc = spark.createDataFrame([(0, "q?", ["a", "b"], "1"), (1, "q?", ["a", "b"], "5"), (2, "q?", ["a"], "0"), (3, "q?", ["a", "b"], None)], "i int, question string, options array<string>, answer string")
    assert [(r.question, r.gold) for r in E.EXTRACTORS["mmlu_pro"](mc).collect()] == [("q?\n\nA) a\nB) b", "B")]
    arc = spark.createDataFrame([(0, "q", ["x", "y"], ["1", "2"], "2"), (1, "q", ["x", "y"], ["1", "2"], "9")], "i int, question string, texts array<string>, labels array<string>, key string")
    assert [r.gold for r in E.EXTRACTORS["arc_easy"](arc).collect()] == ["B"]
    g = spark.createDataFrame([(0, "q", "so #### 7"), (1, "q", "none")], "i int, question string, answer string")
    assert [r.gold for r in E.EXTRACTORS["gsm8k"](g).collect()] == ["7"]
    m = spark.createDataFrame([(0, "Level 5", "p", r"\boxed{3}"), (1, "Level ?", "p", r"\boxed{3}")], "i int, level string, problem string, solution string")
    assert E.EXTRACTORS["math"](m).count() == 1
    chat = spark.createDataFrame([(0, [("user", "hi"), ("assistant", "yo")]), (1, [("system", "s"), ("user", "hi")])], "i int, messages array<struct<role: string, content: string>>")
    assert [r.i for r in E.EXTRACTORS["tulu3"](chat).collect()] == [0] and E.EXTRACTORS["norobots"](chat).count() == 2
    tree = spark.createDataFrame([("t", 2, "prompter", "en", "later"), ("t", 1, "prompter", "", "first"), ("t", 0, "assistant", "en", "no")], "tree string, i int, role string, lang string, text string")
    assert [r.question for r in E.EXTRACTORS["oasst_top"](tree).collect()] == ["first"]
    hot = spark.createDataFrame([(0, "q", ["T"], [["a", "b"]], "yes")], "i int, question string, titles array<string>, sentences array<array<string>>, answer string")
    assert E.EXTRACTORS["hotpotqa"](hot).first().question == "### T\na b\n\nq"
    registry = spark.createDataFrame([("g", "math", "gsm8k"), ("n", "x", "nothing"), ("h", "x", "hotpotqa")], "source string, category string, extractor string")
    rows, skipped = E.extract_all({"g": g}, registry)
    assert rows.count() == 1 and skipped == {"n": "no extractor", "h": "no table"}


def test_packing_blocks(spark):
    rows = [(1, [1, 2, 3], [0, 1, 1]), (2, [4, 5], [1, 1]), (3, [6], [1]), (4, list(range(9)), [1] * 9)]
    got = P.pack_blocks(spark.createDataFrame(rows, "k int, ids array<int>, mask array<int>"), "k", "ids", "mask", 4, 0, 1).orderBy("block_no").collect()
    assert [r.input_ids for r in got] == [[1, 2, 3, 0], [4, 5, 6, 0], [0, 1, 2, 3]]
    assert got[0].labels == [-100, 2, 3, -100] and got[1].position_ids == [0, 1, 0, 0]
    whole = P.pack_blocks(spark.createDataFrame(rows, "k int, ids array<int>, mask array<int>"), "k", "ids", "mask", 4, 0, 1, longer="split").collect()
    assert sum(x != P.IGNORED for r in whole for x in r.labels) == 14  # of 15 tokens one is masked
    assert tuple(P.cut_tokens(spark.createDataFrame(rows, "k int, ids array<int>, mask array<int>"), "ids", 4).first()) == (1, 5)


class Stub:
    def __init__(self):
        self.calls = 0

    def generate(self, prompt):
        self.calls += 1
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    def score(self, prompt, continuation):
        return float(len(continuation))


def test_seams(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "k int, p string")
    got = {r.k: (r.answer, r.error) for r in seams.call(df, "k", "p", Stub, wait=lambda s: None).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: no")}
    o = spark.createDataFrame([(1, "p", ["x", "yyy", "zzz"])], "k int, p string, o array<string>")
    r = seams.score_options(o, "k", "p", "o", Stub).first()
    assert r.best == 1 and abs(sum(r.probabilities) - 1) < 1e-9


def test_stream_consumer_is_idempotent(spark, tmp_path):
    log, out, progress = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    df = spark.createDataFrame([(k, f"q{k}") for k in range(10)], "k int, q string")
    df.write.parquet(log)
    step = lambda b: b.withColumn("a", F.upper("q"))
    for _ in range(2):
        I.consume(spark, log, df.schema, out, ["k"], step, progress)
    df.withColumn("k", F.col("k") + 5).write.mode("append").parquet(log)
    I.consume(spark, log, df.schema, out, ["k"], step, progress, files_per_batch=1)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(15))


def test_updates_of_several_batches_are_kept_by_key(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = [("a", 1, True), ("a", 2, False), ("b", 3, False)], [("a", 5, True), ("a", 4, False), ("c", 6, True)]
    for part in rows:
        spark.createDataFrame(part, "user string, seq int, good boolean").coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema("user string, seq int, good boolean").option("maxFilesPerTrigger", 1).parquet(log)
    filled = I.fill_to_target(stream, "user", "good", 2, 3)
    I.run_available(filled, I.keep_batch(out), str(tmp_path / "ck"), "update")
    got = {r.user: (r.filled, r.failures, r.state) for r in I.kept(spark, out, filled.schema, "update", ["user"]).collect()}
    assert got == {"a": (2, 0, "filled"), "b": (0, 1, "open"), "c": (1, 0, "open")}
    assert I.kept(spark, str(tmp_path / "none"), filled.schema).count() == 0


def test_asof_interval_and_lineage(spark):
    left = spark.createDataFrame([("a", 5, "p"), ("a", 0, "q"), ("b", 9, "r"), ("a", 25, "s")], "k string, t int, n string")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 3), ("a", 3, 7), ("b", 10, 2), ("a", 12, None)], "k string, t int, v int")
    got = {r.n: r.v for r in J.asof_join(left, right, "k", "t", "v", F.floor(F.col("t") / 10)).collect()}
    assert got == {"p": 3, "q": None, "r": None, "s": 3}
    points = spark.createDataFrame([(k,) for k in (1, 10, 11, 30, -5)], "x long")
    spans = spark.createDataFrame([("u", 10, 11), ("v", -(10**9), 10**9), ("w", 40, 50), ("z", 12, 2)], "s string, lo long, hi long")
    assert {(r.x, r.s) for r in J.interval_join(points, spans, "x", "lo", "hi", 10).collect()} == {(10, "u"), (11, "u")} | {(x, "v") for x in (1, 10, 11, 30, -5)}
    nodes = spark.range(64).withColumnRenamed("id", "n")
    parents = nodes.where("n > 0").withColumn("p", F.col("n") - 1)
    assert {(r.n, r.root, r.depth) for r in J.lineage(nodes, parents, "n", "p").collect()} == {(k, 0, k) for k in range(64)}


def test_shared_folder_is_not_made_up_on_a_cluster():
    from types import SimpleNamespace as O

    from millrace.session import shared_dir

    none = O(isDefined=lambda: False)
    fake = O(conf=O(get=lambda k, d=None: d), sparkContext=O(_jsc=O(sc=lambda: O(getCheckpointDir=lambda: none)), master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_saved_index_and_short_items(spark, tmp_path):
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["cat sat", "at", "q", "one two three", " ".join(f"w{i}" for i in range(20)), "", None])], "item int, text string")
    docs = spark.createDataFrame([("a", "the concat satire"), ("b", "One, two; three!"), ("c", "x " + " ".join(f"w{i}" for i in range(15))), ("d", None), ("e", "queue")], "id string, text string")
    got = {(r.id, r.item) for r in C.substring_leaks(docs, items, "id", "item").collect()}
    assert got == {("a", 0), ("a", 1), ("b", 3), ("e", 2)}
    C.save_index(items, str(tmp_path / "index"))
    exact, grams, n = C.load_index(spark, str(tmp_path / "index"))
    assert n == 13 and {(r.id, r.overlap) for r in C.gram_leaks(docs, grams, "id", n).collect()} == {("c", 3)}
    assert {r.id for r in C.exact_leaks(docs, exact).collect()} == {"b"}
    low = {(r.id, r.item) for r in C.window_leaks(docs, items, "id", "item", threshold=0.1).collect()}
    assert ("b", 3) in low and ("c", 4) not in low  # a stretch needs as many words as the item


def test_retry_until_done(spark):
    rows = spark.createDataFrame([(k, "error") for k in range(6)], "k int, status string")
    attempt = lambda open_, n: open_.withColumn("status", F.when(F.col("k") <= n, "ok").otherwise("error"))
    done = I.retry_until_done(rows, attempt, ["k"], "status", 3)
    assert {r.k for r in done.where("status = 'ok'").collect()} == {0, 1, 2}
