"""Evaluation texts leaking into training text.

Q-gram lemma filtering. Items are a small query set, held against every document in
blocks of at most ``block_chars`` characters of items, so the broadcast index has a
bound that does not depend on either table. All blocks are tried in one scan.

Per batch of documents, on folded words joined by single blanks, two filters of the
same kind: count shared grams in a band, keep the bands that meet the edit budget.

*In order.* Every character q-gram is hashed (doubling: 2, 4, 8, 12 characters) and
looked up in the index of the items' q-grams. Each hit is an (item, diagonal) point,
diagonal = place in the document - place in the item. Points are sorted; a band of width
``w`` starting at *any* point is kept if it holds at least the number of q-grams the lemma
leaves an acceptable region. For an item of ``m`` characters where ``e`` words may be
altered that is ``m - q + 1 - sum(len + q over its e longest words)``; for a verbatim run
of ``run`` words it is the number of q-grams in the shortest such run. A band belongs to
the document that holds its first q-gram, which also gives its diagonal in words. The
region is verified by a banded alignment of words (bit-parallel; ``e`` words plus what the
band's characters can amount to on either side), then by the exact rule.

*In any order.* The rule counts distinct words, whatever their order, which breaks
q-grams across words but none inside a word. So whole words are the grams here, and the
band is as wide as the item has words. At most ``floor((1 - share) * d)`` of the ``d``
distinct words of an item may be missing from a stretch that meets the rule; of any set of
``r`` of its words at least ``r - floor((1 - share) * d)`` are therefore in the stretch. The
set taken is the words found in the fewest items. Repeated words are counted
with their repetitions, which keeps more, never less. Stretches kept are verified exactly.

The rule: a shared run of ``run`` words, or a stretch of as many words as the item has
whose distinct words overlap to ``share``.

Defined cases: null, empty and short texts leak nothing; null or empty items leak
nowhere; repeated rows of an id and repeated items count once; empty tables give no
rows; a very long text is scanned in slices overlapping by more than any region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import words

Q = 12
_B = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BITS = 22
SLICE = 4_000_000


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of 12 codes, from those of 2, 4 and 8."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    two = codes[:-1] * _B[0] + codes[1:]
    two ^= two >> np.uint64(31)
    four = two[:-2] * _B[1] + two[2:]
    four ^= four >> np.uint64(33)
    eight = four[:-4] * _B[2] + four[4:]
    out = eight[:n] * _B[0] + four[8 : 8 + n]
    out ^= out >> np.uint64(32)
    out *= _B[1]
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Index:
    """Q-grams of one block of items, with each item's bound and band width."""

    def __init__(self, items: list[tuple[int, str]], run: int, share: float):
        self.run, self.share = run, share
        self.ids, self.words, bound, band = [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            line = " ".join(found)
            h = gram_hashes(codes_of(line))
            lengths = np.array([len(x) for x in found])
            starts = np.concatenate([[0], np.cumsum(lengths + 1)])
            edits = int(len(found) * (1 - share) / (1 + share))
            longest = np.sort(lengths)[len(lengths) - edits :]
            least = len(h) - int((longest + Q).sum())
            if len(found) >= run:
                least = min(least, int((starts[run:] - 1 - starts[: len(starts) - run]).min()) - Q + 1)
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(found)
            bound.append(max(1, least))
            band.append(max(48, 10 * edits))
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        self.bound, self.band = np.array(bound, np.int64), np.array(band, np.int64)
        self.sets = [set(x) for x in self.words]
        self.edits = np.array([int(len(x) * (1 - share) / (1 + share)) for x in self.words], np.int64)
        self.starts = [np.concatenate([[0], np.cumsum([len(w) + 1 for w in x])]) for x in self.words]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.masks: list[dict[str, int]] = []
        for found in self.words:
            masks: dict[str, int] = {}
            for i, w in enumerate(found):
                masks[w] = masks.get(w, 0) | (1 << i)
            self.masks.append(masks)
        self._any_order()
        self.runs: dict[tuple, set[int]] = {}
        for k, found in enumerate(self.words):
            for i in range(len(found) - run + 1):
                self.runs.setdefault(tuple(found[i : i + run]), set()).add(k)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = (np.concatenate(owner) if hashes else np.empty(0, np.int64))[order].astype(np.int64)
        self.place = (np.concatenate(place) if hashes else np.empty(0, np.int64))[order].astype(np.int64)
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << BITS, np.bool_)
        self.maybe[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def _any_order(self) -> None:
        """Postings of the words that stand for each item, and how many of them a stretch must hold."""
        spread: dict[str, int] = {}
        for x in self.sets:
            for w in x:
                spread[w] = spread.get(w, 0) + 1
        lists: dict[str, list[int]] = {}
        self.need = np.ones(len(self.sets), np.int64)
        for k, x in enumerate(self.sets):
            missing = int((1 - self.share) * len(x) + 1e-9)
            chosen = sorted(x, key=lambda w: (spread[w], -len(w), w))[: missing + -(-len(x) // 4) + 1]
            self.need[k] = len(chosen) - missing
            for w in chosen:
                lists.setdefault(w, []).append(k)
        self.vocabulary = {w: i for i, w in enumerate(lists)}
        self.posting_first = np.concatenate([[0], np.cumsum([len(x) for x in lists.values()])]).astype(np.int64)
        self.posting = np.array([k for x in lists.values() for k in x], np.int64)

    def stretches(self, members: list[tuple[int, list[str], int]]) -> Iterator[tuple[int, int, int, int]]:
        """(member, item, first word, end word) of stretches that hold enough of an item's words, in any order."""
        if not len(self.posting):
            return
        gap = int(self.size.max())
        get = self.vocabulary.get
        lengths = np.array([len(m[1]) for m in members], np.int64)
        ids = np.fromiter((get(w, -1) for m in members for w in m[1]), np.int64, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths + gap * np.arange(len(members))  # no stretch reaches from one member to the next
        at = np.flatnonzero(ids >= 0)
        ids = ids[at]
        at = at + gap * (np.searchsorted(np.cumsum(lengths), at, side="right"))
        times = self.posting_first[ids + 1] - self.posting_first[ids]
        total = int(times.sum())
        if not total:
            return
        p = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.posting_first[ids], times)
        key = (self.posting[p] << np.int64(40)) + np.repeat(at, times)
        key.sort()
        item = key >> np.int64(40)
        other = np.arange(total) + self.need[item] - 1
        inside = np.flatnonzero(other < total)
        inside = inside[key[other[inside]] - key[inside] < self.size[item[inside]]]
        if not len(inside):
            return
        item, start, end = item[inside], key[inside] & np.int64((1 << 40) - 1), key[other[inside]] & np.int64((1 << 40) - 1)
        lo, hi = end - self.size[item] + 1, start + self.size[item]  # every stretch of the item's size that holds them
        member = np.searchsorted(first, start, side="right") - 1
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (member[1:] != member[:-1]) | (lo[1:] > hi[:-1])
        group = np.flatnonzero(new)
        last = np.append(group[1:], len(item)) - 1
        for g, z in zip(group.tolist(), last.tolist()):
            m = int(member[g])
            yield m, int(item[g]), max(0, int(lo[g] - first[m])), int(hi[g : z + 1].max() - first[m])

    def regions(self, line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, diagonal, place of its first q-gram in the text) of each band that meets its item's bound."""
        h = gram_hashes(codes_of(line))
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        h = h[at]
        g = np.searchsorted(self.grams, h)
        g[g == len(self.grams)] = 0
        real = self.grams[g] == h
        at, g = at[real], g[real]
        times = self.times[g]
        total = int(times.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(times)
        p = np.arange(total) - np.repeat(ends - times, times) + np.repeat(self.first[g], times)
        item = self.owner[p]
        at = np.repeat(at, times)
        key = (item << np.int64(40)) + (at - self.place[p] + (1 << 20))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        item = key >> np.int64(40)
        # of the sorted points, the bound-th from this one must still lie in its band
        other = np.arange(total) + self.bound[item] - 1
        inside = np.flatnonzero(other < total)
        inside = inside[key[other[inside]] - key[inside] <= self.band[item[inside]]]
        return item[inside], (key[inside] & np.int64((1 << 40) - 1)) - (1 << 20), at[inside]

    def holds(self, found: list[str], k: int, diagonal: int) -> bool:
        """Banded alignment of the item with the words around a diagonal, then the exact rule there."""
        n, edits = len(self.words[k]), int(self.edits[k])
        band = edits + int(self.band[k]) // 2 + 1
        lo = max(0, diagonal - band)
        region = found[lo : max(0, diagonal + n + band)]
        if aligned(self.masks[k], n, region, diagonal - lo, band) < (self.run if n >= self.run else n - edits):
            return False
        for i in range(len(region) - self.run + 1):
            if k in self.runs.get(tuple(region[i : i + self.run]), ()):
                return True
        return len(region) >= n and best_window(region, n, self.sets[k], self.share) >= self.share


def aligned(masks: dict[str, int], n: int, region: list[str], shift: int, band: int) -> int:
    """Words matched by the best alignment of an item of ``n`` words with ``region`` within ``band`` of the diagonal ``shift``.

    ``masks`` has the places of each word of the item as bits; a row of the table is one integer.
    """
    full = (1 << n) - 1
    row = full
    for j, w in enumerate(region):
        match = masks.get(w, 0)
        if match:
            lo, hi = max(0, j - shift - band), j - shift + band
            match &= ((1 << (hi + 1)) - 1) >> lo << lo if hi >= 0 else 0
            if match:
                step = row & match
                row = ((row + step) | (row - step)) & full
    return n - row.bit_count()


def best_window(region: list[str], n: int, target: set[str], enough: float = 2.0) -> float:
    """Largest overlap of distinct words of ``target`` with a stretch of ``n`` words; the first one that is ``enough`` will do."""
    counts: dict[str, int] = {}
    common, best = 0, 0.0
    for i, x in enumerate(region):
        counts[x] = counts.get(x, 0) + 1
        if counts[x] == 1 and x in target:
            common += 1
        if i >= n:
            y = region[i - n]
            counts[y] -= 1
            if not counts[y]:
                del counts[y]
                common -= y in target
        if i >= n - 1:
            best = max(best, common / (len(counts) + len(target) - common))
            if best >= enough:
                break
    return best


def _lines(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, list[str], np.ndarray]]]]:
    """Documents laid end to end, at most about SLICE characters at a time; a longer text comes in overlapping parts."""
    parts, members, size = [], [], 0
    for d, text in enumerate(texts):
        found = words(text)
        step = SLICE // 8
        for lo in range(0, max(1, len(found)), step):
            piece = found[lo : lo + step + step // 8]
            line = " ".join(piece)
            parts.append(line)
            members.append((d, piece, size))
            size += len(line) + 1
            if size >= SLICE:
                yield "\x00".join(parts), members
                parts, members, size = [], [], 0
            if lo + step + step // 8 >= len(found):
                break
    if parts:
        yield "\x00".join(parts), members


def _scan(index: Index, line: str, members: list[tuple[int, list[str], int]]) -> set[tuple[int, int]]:
    """(document, item) pairs that hold among the members of a line."""
    done: set[tuple[int, int]] = set()
    item, diagonal, at = index.regions(line)
    if len(item):
        offsets = np.array([m[2] for m in members])
        owner = np.searchsorted(offsets, at, side="right") - 1
        for m in np.unique(owner).tolist():
            d, found, offset = members[m]
            own = np.flatnonzero(owner == m)
            starts = np.cumsum([0, *(len(x) + 1 for x in found)])
            # the band's first q-gram, in words: of the document, and of the item
            there = np.searchsorted(starts, at[own] - offset, side="right") - 1
            hits = set()
            for k in np.unique(item[own]).tolist():
                mine = item[own] == k
                here = np.searchsorted(index.starts[k], at[own][mine] - diagonal[own][mine], side="right") - 1
                hits |= {(k, x) for x in np.unique(there[mine] - here).tolist()}
            for k, diag in sorted(hits):
                if (d, index.ids[k]) not in done and index.holds(found, k, diag):
                    done.add((d, index.ids[k]))
    for m, k, lo, hi in index.stretches(members):
        d, found, _ = members[m]
        if (d, index.ids[k]) not in done and best_window(found[lo:hi], len(index.words[k]), index.sets[k], index.share) >= index.share:
            done.add((d, index.ids[k]))
    return done


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = 13, share: float = 0.7, block_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id): every document with every item it holds wholly or partly.

    Items are indexed in blocks of about ``block_chars`` characters, which bounds what an executor
    holds at a time; more items make more blocks, tried one after the other on each batch.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND trim(text) <> ''").distinct()
    blocks = max(1, -(-(queries.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND length(text) > 0")
    indexes = []
    for part in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).collect()  # about block_chars characters
        indexes.append(spark.sparkContext.broadcast(Index(sorted((r.item_id, r.text) for r in rows), run, share)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found: set[tuple[int, int]] = set()
            for line, members in _lines(batch.column(1).to_pylist()):
                for index in indexes:
                    found |= _scan(index.value, line, members)
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.int64())], names=["id", "item_id"])

    return source.mapInArrow(scan, "id string, item_id long").distinct()
