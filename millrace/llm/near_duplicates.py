"""Near-duplicate records with small edits.

Many universal hash minima with banding, signature verification and connected
components by alternating large-star and small-star.

1. One pass over the texts gives each record a *content class* (hash of its word
   sequence: records equal word for word are one class) and ``bands * rows``
   minima of the universal functions ``(a*x + b) mod 2**32``, ``a`` odd, over its
   distinct runs of ``shingle`` words. Of each minimum 16 bits are kept, four per
   long: the long of a band is both its key and that part of the signature. A task
   signs each class once; further copies it meets carry no signature, so a hot group
   of copies costs one row a task from here on.
2. Classes sharing a band key meet in a bucket. Keys that hold a large share of the
   classes are found beforehand from the classes whose hash is divisible by
   ``HOT_PART`` (it only decides how rows are spread, no row depends on it) and are
   spread over tasks by class. Buckets above ``block`` classes are split
   into blocks which are joined pair by pair in different tasks: no bucket is held
   by one task, nothing is cut off.
3. Each distinct candidate pair is verified with the signatures; survivors may be
   verified exactly with the shingle sets of the classes concerned.
4. Links between classes, and between the classes of an id delivered with several
   texts, are closed to groups by large-star / small-star rounds, each checkpointed in
   the shared folder. A hub's neighbourhood is reduced to its least member before the
   shuffle; the join that tells the members is split by adaptive execution if it is skewed.

Defined cases: null or short texts (under ``min_words`` words, or without a
shingle) are in no pair and form groups of their own, equal word sequences one
group, a text without words one for its id (``duplicate_groups`` has their rows
with ``every``; an id that also has a longer text stands by that); repeated rows of one id
count once; an id delivered with different texts is linked through any of them;
an empty table gives empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from millrace.llm.words import WORD, WordHashes, fold, shingles
from millrace.session import checkpoint, materialise

LANES = 4  # 16-bit minima per long: rows of a band
HOT_PART, HOT_SHARE = 16, 0.001  # part of the classes that is looked at for hot keys; share of them that makes a key hot
SIGNED_CLASSES = 500_000  # classes a task remembers to have signed

_SIGNED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("cls", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("sig", T.ArrayType(T.LongType(), False)),
    ]
)
_ARROW_SIGNED = pa.schema([("id", pa.string()), ("cls", pa.int64()), ("n", pa.int32()), ("sig", pa.list_(pa.int64()))])


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)), rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each function over the fingerprints ``x`` (uint32)."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 256):  # blocks that stay in the cache, whatever the length of the text
        h = np.multiply.outer(x[s : s + 256], a)
        h += b
        np.minimum(out, h.min(axis=0), out=out)
    return out


def signed(docs: DataFrame, id_col: str = "id", text_col: str = "text", shingle: int = 5, bands: int = 56, min_words: int = 5, seed: int = 7, every: bool = False) -> DataFrame:
    """(id, cls, n, sig) of each record long enough; ``sig`` has one long per band, and is empty where the task has signed the class before.

    With ``every`` also of the null and short ones, ``n`` being 0 and ``sig`` empty.
    """
    a, b = hash_family(bands * LANES, seed)
    shift = (np.arange(LANES, dtype=np.uint64) * np.uint64(16))[None, :]
    least = max(min_words, shingle)
    unsigned = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        seen: dict[int, int] = {}  # class -> shingles
        for batch in batches:
            ids, classes, sizes, sigs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = WORD.findall(fold(text or ""))
                if len(found) < least:
                    if every:
                        own = cache.of(found).tobytes() if found else b"\0" + i.encode("utf-8", "surrogatepass")
                        ids.append(i)
                        classes.append(xxhash.xxh3_64_intdigest(own) - 2**63)
                        sizes.append(0)
                        sigs.append(unsigned)
                    continue
                hashes = cache.of(found)
                cls = xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63
                n, sig = seen.get(cls, 0), unsigned
                if not n:
                    x = np.unique(shingles(hashes, shingle)).astype(np.uint32)
                    low = (minima(x, a, b) & np.uint32(0xFFFF)).astype(np.uint64).reshape(-1, LANES)
                    n, sig = len(x), (low << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
                    if len(seen) >= SIGNED_CLASSES:
                        seen.clear()
                    seen[cls] = n
                ids.append(i)
                classes.append(cls)
                sizes.append(n)
                sigs.append(sig)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, sigs)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                schema=_ARROW_SIGNED,
            )

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL" if every else "id IS NOT NULL AND text IS NOT NULL")
    return source.mapInArrow(run, _SIGNED)


def hot_keys(keyed: DataFrame) -> DataFrame:
    """Band keys that hold a large share of the classes: at most ``bands / HOT_SHARE`` rows, whatever the data."""
    part = keyed.where(F.pmod(F.xxhash64("cls"), F.lit(HOT_PART)) == 0)
    classes = part.agg(F.approx_count_distinct("cls")).first()[0]
    return part.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= max(32, int(HOT_SHARE * classes))).select("key", F.lit(True).alias("hot"))


def paired(rows: DataFrame, key: str, value: str, block: int = 64) -> DataFrame:
    """(a, b) with a < b: all pairs of different values sharing a key; ``rows`` are distinct.

    Keys with up to ``block`` values are one block; larger ones are split by hash into
    ceil(m / block) blocks, and each pair of blocks is a key of its own for the join.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("m")).where("m > 1")
    sized = rows.select(key, value).join(counts, key)
    parts = F.ceil(F.col("m") / block).cast("int")
    blocked = sized.select(key, value, F.pmod(F.xxhash64(value), parts).cast("int").alias("own"), parts.alias("parts"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = blocked.select(key, F.col(value).alias("a"), F.col("own").alias("p"), others.alias("q"))
    right = blocked.select(key, F.col(value).alias("b"), F.col("own").alias("q"), others.alias("p"))
    return left.join(right, [key, "p", "q"]).where("a < b").select("a", "b")


def candidates(sig: DataFrame, block: int = 64) -> DataFrame:
    """Distinct pairs of classes (a < b) sharing a band key; ``sig`` has one or more rows per class."""
    keyed = sig.select("cls", F.posexplode("sig").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "cls")
    # a hot key is spread by class; it needs no look at its least and greatest class to be known as shared
    spread = keyed.join(F.broadcast(hot_keys(keyed)), "key", "left").withColumn("salt", F.when(F.col("hot"), F.col("cls")).otherwise(F.lit(0).cast("long")))
    by = W.partitionBy("key", "salt")
    met = spread.withColumn("lo", F.min("cls").over(by)).withColumn("hi", F.max("cls").over(by)).where("hot OR lo < hi").select("key", "salt", "cls").distinct()
    return paired(materialise(met.select("key", "cls")), "key", "cls", block).distinct()


def _agreement() -> F.Column:
    """Share of equal 16-bit minima of two signatures."""
    lane = lambda x, s: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0xFFFF))
    same = F.zip_with("sa", "sb", lambda x, y: sum(((lane(x.bitwiseXOR(y), 16 * k) == 0).cast("int") for k in range(LANES)), F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / (LANES * F.size("sa"))


def verified(sig: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Candidate pairs whose signatures agree in at least ``least`` of the minima."""
    one = sig.where(F.size("sig") > 0).join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("sig").alias("sig"))
    joined = pairs.join(one.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(one.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.select("a", "b", _agreement().alias("estimate")).where(F.col("estimate") >= least)


def exact(docs: DataFrame, sig: DataFrame, pairs: DataFrame, threshold: float, shingle: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pairs of classes whose shingle sets reach ``threshold``; reads only the texts of one record per class concerned."""
    of = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    reps = sig.join(of, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "n")).alias("r")).select("cls", F.col("r.id").alias("id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys, out = [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = cache.of(WORD.findall(fold(text)))
                if xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63 == cls:
                    keys.append(cls)
                    out.append(np.unique(shingles(hashes, shingle)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["cls", "grams"])

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    grams = reps.join(texts, "id").select("cls", "text").mapInArrow(sets, "cls long, grams array<long>").groupBy("cls").agg(F.first("grams").alias("grams"))
    grams = materialise(grams)
    shared = F.size(F.array_intersect("ga", "gb"))
    joined = pairs.select("a", "b").join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    return joined.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) from undirected links (a, b): alternating large-star and small-star until nothing changes.

    ``root`` is the smallest node of the component. Each star only takes the minimum
    of a neighbourhood and re-links its members, so a hub costs one row per
    neighbour (pre-aggregated before the shuffle) and no list is collected.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        told = both.join(low, "a")
        if large:  # neighbours above the node go to the least of the neighbourhood
            return told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = told.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()

    def state(edges: DataFrame) -> tuple:
        r = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) AS DECIMAL(38, 0)))")).first()
        return tuple(r)

    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    for _ in range(max_rounds):
        edges = checkpoint(star(star(edges, True).where("a <> b"), False).where("a <> b"))
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, min_words: int = 5, bands: int = 56, slack: float = 0.12, seed: int = 7, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, groups).

    members: (id, cls, long), one row per id and class, with ``every`` also of null
    and short texts, which are not long; links: (a, b, jaccard) between
    different classes, exact; groups: (cls, root) for every linked class.
    ``slack`` is what a signature may lie under the threshold before the exact check
    (four standard errors of 224 minima).
    """
    told = materialise(signed(docs, id_col, text_col, shingle, bands, min_words, seed, every))
    sig = told.where("n > 0")
    likely = materialise(verified(sig, candidates(sig), threshold - slack))
    links = materialise(exact(docs, sig, likely, threshold, shingle, id_col, text_col))
    # the classes of an id delivered with several texts belong together
    several = sig.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("hi")).where("a < hi").select("id", "a")
    same_id = sig.select("id", "cls").join(several, "id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    roots = components(links.select("a", "b").union(same_id))
    return told.select("id", "cls", (F.col("n") > 0).alias("long")).distinct(), links, roots.select(F.col("node").alias("cls"), "root")


def duplicate_groups(docs: DataFrame, every: bool = False, **kw) -> DataFrame:
    """One row per id with a text long enough, with ``every`` one per id: its group (least class linked to it) and its number of links to other classes."""
    members, links, groups = near_duplicates(docs, every=every, **kw)
    group = F.coalesce("root", "cls")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return (
        members.join(groups, "cls", "left")
        .join(degree, "cls", "left")
        .groupBy("id")
        .agg(F.coalesce(F.min(F.when(F.col("long"), group)), F.min(group)).alias("group_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))
    )


def duplicate_pairs(docs: DataFrame, **kw) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids of one class, and ids of linked classes of one group."""
    members, links, groups = near_duplicates(docs, **kw)
    members = materialise(members)
    grouped = links.join(groups.withColumnRenamed("cls", "a"), "a").select("a", "b", "root")
    x, y = members.select(F.col("cls").alias("a"), F.col("id").alias("ia")), members.select(F.col("cls").alias("b"), F.col("id").alias("ib"))
    across = grouped.join(x, "a").join(y, "b").select("ia", "ib")
    within = paired(members.select("cls", "id").distinct(), "cls", "id").select(F.col("a").alias("ia"), F.col("b").alias("ib"))
    return across.union(within).where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
