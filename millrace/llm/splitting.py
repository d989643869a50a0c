"""Splitting oversized items at natural boundaries, by pointer doubling.

Cuts lie where a natural boundary is: before or after a line break, before or after
white space that follows one of ``. ! ? ؟ …``, and at both ends of the text.

1. Each text over ``limit`` characters becomes a list of boundary positions, found in
   the scan: no text is shuffled, repeated rows are told by a hash of the text, and the
   positions become a table of boundaries (key, pos). Where more than ``limit`` characters
   stand between neighbouring boundaries, forced positions are added every
   ``limit - overlap`` characters after the first of the two.
2. Every boundary is joined to its farthest legal successor: the farthest one at most
   ``limit - overlap`` away (the next piece starts ``overlap`` characters before the
   cut); if there is none, the next one, with the overlap shortened to fit.
3. Pointer doubling: the cuts reached from 0 are a set R. With the table T of 2**k-fold
   successors, R gains T(R), then T is squared (T joined with itself), until every end
   is reached. Rounds grow with the logarithm of the number of pieces of the longest
   text, and all cuts of all texts are found together. Tables are kept partitioned by
   text, and a table only keeps texts that still need it.
4. Consecutive cuts (p, e) give a piece [max(p - overlap, e - limit, 0), e).

Piece text, rejoined without the overlaps, is the text, character for character.

Defined cases: null ids or texts give no rows; a text within the limit (also an empty
one) is one piece; repeated rows of (id, text) count once, an id with several texts
keeps the pieces of each apart by ``version``; an empty table gives no rows. Characters are code
points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import materialise

BREAK = r"\n\r\x0b\x0c\x85\u2028\u2029"
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: a boundary lies at both ends of each match: a line break, or white space after the end of a sentence
BOUNDARY = re.compile(rf"[{BREAK}]|(?<=[.!?؟…])[{SPACE}]")


def positions(text: str) -> np.ndarray:
    """Rising boundary positions of a text, both ends included."""
    at = np.array([m.start() for m in BOUNDARY.finditer(text)], np.int64)
    return np.unique(np.concatenate([at, at + 1, [0, len(text)]]))


def boundaries(texts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, pos, forced, n): cut positions of texts longer than ``limit``; ``texts`` has key (a struct of id and version) and text, rows may repeat."""
    step = limit - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [positions(t) for t in batch.column(2).to_pylist()]
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, rows)])
            n = pa.array([int(r[-1]) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["id", "version", "n", "at"])

    long_ = texts.where(F.length("text") > limit).select("key.id", "key.version", "text").mapInArrow(run, "id string, version long, n long, at array<long>")
    once = long_.dropDuplicates(["id", "version"]).select(F.struct("id", "version").alias("key"), "n", "at")
    # from each position to the next; the last one has no gap after it
    gaps = once.select("key", "n", F.explode(F.arrays_zip("at", F.slice("at", 2, F.size("at")).alias("after"))).alias("g")).select("key", "n", F.col("g.at").alias("pos"), F.col("g.after").alias("after"))
    spread = F.when(F.col("after") - F.col("pos") > limit, F.sequence(F.col("pos") + step, F.col("after") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    marks = F.concat(F.array(F.struct(F.col("pos"), F.lit(False).alias("forced"))), F.transform(spread, lambda x: F.struct(x.alias("pos"), F.lit(True).alias("forced"))))
    return gaps.select("key", "n", F.explode(marks).alias("m")).select("key", "m.pos", "m.forced", "n")


def successors(marks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, pos, nxt, n): the farthest legal successor of each boundary, natural ones first."""
    step = limit - overlap
    ahead = W.partitionBy("key").orderBy("pos")
    near, far = ahead.rangeBetween(1, step), ahead.rangeBetween(1, limit)
    own = F.when(~F.col("forced"), F.col("pos"))
    return (
        marks.withColumn("natural", F.max(own).over(near))
        .withColumn("reach", F.min(own).over(far))
        .withColumn("next", F.min("pos").over(ahead.rangeBetween(1, W.unboundedFollowing)))
        .select("key", "pos", F.coalesce("natural", "reach", "next").alias("nxt"), "n")
        .where("nxt IS NOT NULL")
    )


def cuts(texts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, pos, forced, n): all greedy cuts of each oversized text, by pointer doubling."""
    marks = materialise(boundaries(texts, limit, overlap))
    table = successors(marks, limit, overlap)
    reached = marks.where("pos = 0").select("key", "pos", "n")
    longest = marks.agg(F.max("n")).first()[0] or 0
    step, k = limit - overlap, 0
    # two successive cuts always lie more than one step apart, so a text has at most 2n / step + 2 cuts
    while 2**k <= 2 * longest / step + 2:
        table = materialise(table)
        jumped = reached.join(table.select("key", "pos", "nxt").hint("merge"), ["key", "pos"]).select("key", F.col("nxt").alias("pos"), "n")
        reached = reached.union(jumped)
        k += 1
        open_ = table.where(F.lit(2**k) <= 2 * F.col("n") / step + 2)
        table = open_.alias("a").join(open_.select("key", F.col("pos").alias("nxt"), F.col("nxt").alias("then")).hint("merge"), ["key", "nxt"]).select("key", "pos", F.col("then").alias("nxt"), "n")
    return reached.join(marks.select("key", "pos", "forced").hint("merge"), ["key", "pos"])


def pieces(docs: DataFrame, limit: int = 2000, overlap: int = 200, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, version, piece, start, end, forced, overlap, text): pieces of every text, all within ``limit``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie in [0, limit)")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    keyed = texts.select("id", "text", F.xxhash64("text").alias("version"))
    once = keyed.dropDuplicates(["id", "version"]).withColumn("key", F.struct("id", "version"))
    whole = once.where(F.length("text") <= limit).select("id", "version", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.lit(False).alias("forced"), F.lit(0).cast("long").alias("overlap"), "text")
    found = spans(keyed.select(F.struct("id", "version").alias("key"), "text"), limit, overlap)
    cut = found.join(once.select("key", "text"), "key").select(
        "key.id", "key.version", "piece", "start", "end", "forced", "overlap", F.expr("substring(text, CAST(start AS INT) + 1, CAST(end - start AS INT))").alias("text")
    )
    return whole.unionByName(cut)


def spans(texts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, piece, start, end, forced, overlap) of oversized texts; ``texts`` has key and text."""
    by = W.partitionBy("key").orderBy("pos")
    ends = cuts(texts, limit, overlap).dropDuplicates(["key", "pos"]).withColumn("from", F.lag("pos").over(by)).withColumn("piece", F.row_number().over(by) - 2)
    start = F.greatest(F.col("from") - overlap, F.col("pos") - limit, F.lit(0).cast("long"))
    return ends.where("from IS NOT NULL").select("key", "piece", start.alias("start"), F.col("pos").alias("end"), "forced", F.when(F.col("from") > 0, F.col("from") - start).otherwise(F.lit(0).cast("long")).alias("overlap"))


def oversized(docs: DataFrame, limit: int = 2000, overlap: int = 200, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, cut) of every text over the limit: ``forced`` if one of its pieces had to end off a natural boundary."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col(id_col).isNotNull() & (F.length(text_col) > limit))
    keyed = texts.select(F.struct("id", F.xxhash64("text").alias("version")).alias("key"), "text")
    return spans(keyed, limit, overlap).groupBy("key.id").agg(F.max("forced").alias("f")).select("id", F.when(F.col("f"), "forced").otherwise("natural").alias("cut"))
