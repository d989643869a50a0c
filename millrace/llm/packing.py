"""Filling fixed-capacity containers: configuration LP over the length histogram.

1. The histogram (length -> number of items) has at most ``capacity`` rows, whatever
   the data; only it goes to the driver. Items over the capacity are divided into full
   containers and a rest; nothing else is ever divided.
2. The configuration LP (fewest containers so that every length is covered) is solved
   by multiplicative weights. The weight of a length starts at its share of the capacity
   and falls exponentially with the times its demand has been covered. Each round prices
   ``AGENTS`` configurations at once, under weights jittered so that they differ, with a
   bounded knapsack dynamic programme (on a grid of the capacity; the room left is used
   up with exact lengths). Rounds go on until every demand is covered ``target`` times
   but for a share ``eps``; the solution divided by ``target`` is the fractional cover.
3. Rounding, in the order of the fractional copies: whole copies first, then one copy
   each, until half of what was left is placed; the rest is a smaller histogram whose LP
   is solved anew, down to the last item. A copy of which some items are gone already is
   taken only if at least ``keep`` of its tokens are still there and the gap can be closed
   (``mended``); the items that close it are counted apart. There is no other rule for any
   size of the histogram.
4. The plan (configuration, copies, and for each length the ranks it takes) has a size
   bounded by the parameters. Items get their rank within their length from counts per
   (length, bucket) plus the rank in the bucket, so a length shared by a third of all
   rows is spread over tasks; the plan turns ranks into containers.

Defined cases: null texts and texts without tokens need no room and get no container
(null); equal items are told apart by id; repeated rows of an id are packed once; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.tokenizers import DEFAULT, with_tokens
from millrace.session import materialise

GRID = 128  # units into which the capacity is divided while pricing
AGENTS = 64  # configurations priced at once


@dataclass
class Plan:
    """Chosen configurations and how they came about."""

    chosen: list[tuple[dict[int, int], int]] = field(default_factory=list)  # ({length: multiplicity}, copies)
    bound: float = 0.0  # dual value of the weights length / capacity: no packing has fewer containers
    lp_value: float = 0.0  # copies of the first fractional cover
    lp_items: int = 0  # items placed by LP configurations
    mended_items: int = 0  # items that closed the gap of an LP configuration


def best_configurations(lengths: np.ndarray, value: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Multiplicities, one row per agent, of (nearly) greatest total value within the capacity and the demand.

    ``value`` has a row per agent. Knapsack dynamic programme over filled units, all
    agents in step: lengths are rounded up to units; of the lengths with the same number
    of units the one an agent values most stands for all, at most as often as it is wanted.
    """
    agents, unit = np.arange(len(value)), max(1, -(-capacity // GRID))
    room, units = capacity // unit, -(-lengths // unit)
    kinds = np.unique(np.minimum(units, room))  # a length that only rounds up beyond the room fits alone
    units = np.minimum(units, room)
    best = np.zeros((len(value), room + 1), np.float32)
    steps = []
    for u, lo, hi in zip(kinds.tolist(), np.searchsorted(units, kinds).tolist(), np.searchsorted(units, kinds, side="right").tolist()):
        col = lo + value[:, lo:hi].argmax(axis=1)
        worth, left = value[agents, col], np.minimum(demand[col], room // u)
        most, k = int(left.max()), 1
        while most > 0:  # 1, 2, 4, ... copies make any number
            take = min(k, most)
            most, k = most - take, 2 * k
            times = np.minimum(take, left)
            left = left - times
            with_it = best[:, : room + 1 - take * u] + (worth * times)[:, None]
            better = (with_it > best[:, take * u :]) & (times > 0)[:, None]
            best = best.copy()
            best[:, take * u :][better] = with_it[better]
            steps.append((take * u, col, times, better))
    out = np.zeros(value.shape, np.int64)
    at = np.full(len(value), room)
    for width, col, times, better in reversed(steps):
        a = np.flatnonzero(at >= width)
        a = a[better[a, at[a] - width]]
        out[a, col[a]] += times[a]
        at[a] -= width
    return out


def fill(lengths: np.ndarray, left: np.ndarray, config: np.ndarray, capacity: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Use up the room of a configuration: add the longest items that fit, then exchange one item for a longer one (of no less weight)."""
    config = np.minimum(config, left)
    free = left - config
    room = capacity - int((config * lengths).sum())
    while room > 0:
        fits = np.flatnonzero(free[: np.searchsorted(lengths, room, side="right")])
        if not len(fits):
            break
        j = fits[-1]
        more = int(min(room // lengths[j], free[j]))
        config[j] += more
        free[j] -= more
        room -= int(more * lengths[j])
    others, used = np.flatnonzero(free), np.flatnonzero(config)
    if room > 0 and len(others) and len(used):
        k = np.searchsorted(lengths[others], lengths[used] + room, side="right") - 1
        gain = np.where(k >= 0, lengths[others[np.maximum(k, 0)]] - lengths[used], 0)
        if weight is not None:
            gain = np.where(weight[others[np.maximum(k, 0)]] >= weight[used], gain, 0)
        i = int(gain.argmax())
        if gain[i] > 0:
            config[used[i]] -= 1
            config[others[k[i]]] += 1
    return config


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, seed: int, eps: float = 0.05, target: float = 4.0, rate: float = 3.0, step: float = 0.5, jitter: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """Fractional cover [(configuration, copies)] of every demand but a share ``eps``; ``lengths`` rise."""
    rng = np.random.default_rng(seed)
    times = np.zeros(len(lengths))  # a demand has been covered
    found: dict[bytes, list] = {}
    while times.min() < target * (1 - eps):
        seen = np.minimum(times, 2 * target)
        weight = lengths / capacity * np.exp(-rate * (seen - seen.mean()))
        value = (weight * (1 + jitter * rng.exponential(1.0, (AGENTS, len(lengths))))).astype(np.float32)
        configs = np.stack([fill(lengths, demand, c, capacity, weight) for c in best_configurations(lengths, value, demand, capacity)])
        share = configs / demand
        # a step covers no open demand by more than ``step``, all agents together no more than once
        wanted = share * (times < target)
        most = wanted.max(axis=1)
        copies = np.where(most > 0, step / np.maximum(most, 1e-12), 0.0)
        copies *= min(1.0, 1 / max((wanted * copies[:, None]).sum(axis=0).max(), 1e-12))
        for c, x in zip(configs, copies):
            found.setdefault(c.tobytes(), [c, 0.0])[1] += x
        times += (share * copies[:, None]).sum(axis=0)
    return [(c, x / target) for c, x in found.values()]


def plan(histogram: dict[int, int], capacity: int, keep: float = 0.9) -> Plan:
    """Configurations placing every item of the histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    out = Plan(bound=float((lengths * left).sum() / capacity))

    def take(ls: np.ndarray, config: np.ndarray, copies: int) -> None:
        used = config > 0
        out.chosen.append(({int(k): int(a) for k, a in zip(ls[used], config[used], strict=True)}, copies))

    dive = 0
    while left.sum():
        live = left > 0
        ls, n = lengths[live], left[live].copy()
        cover = sorted(solve(ls, n, capacity, dive), key=lambda x: -x[1])
        if dive == 0:
            out.lp_value = sum(x for _, x in cover)
        size = [int((c * ls).sum()) for c, _ in cover]
        open_, goal = int((n * ls).sum()), int((n * ls).sum()) // 2
        for (c, x), tokens in zip(cover, size):
            used = c > 0
            whole = min(int(x), int((n[used] // c[used]).min()), -(-(open_ - goal) // tokens))
            if whole > 0:
                n -= c * whole
                open_ -= tokens * whole
                out.lp_items += int(c.sum()) * whole
                take(ls, c, whole)
        for i, ((c, _), tokens) in enumerate(zip(cover, size)):
            if open_ <= goal:
                break
            config = fill(ls, n, c, capacity)
            same = np.minimum(config, c)
            if i and (int((same * ls).sum()) < keep * tokens or int((config * ls).sum()) < tokens):
                continue
            if not config.any():
                continue
            n -= config
            open_ -= int((config * ls).sum())
            out.lp_items += int(same.sum())
            out.mended_items += int((config - same).sum())
            take(ls, config, 1)
        left[live] = n
        dive += 1
    return out


def intervals(chosen: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """(length, first, last, per, base): ranks [first, last) of a length go ``per`` to a container from ``base`` on."""
    rows, at, base = [], {}, 0
    for config, copies in chosen:
        for length, per in config.items():
            first = at.get(length, 0)
            at[length] = first + per * copies
            rows.append((length, first, at[length], per, base))
        base += copies
    return pd.DataFrame(rows, columns=["length", "first", "last", "per", "base"]).astype("int64")


def ranked(items: DataFrame, by: str, key: str, bucket_rows: int = 200_000) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within ``by``, without gathering a value of ``by`` in one task."""
    total = items.count()
    buckets = max(1, -(-total // bucket_rows))
    spread = items.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    counts = spread.groupBy(by, "bucket").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(by, "bucket", before.alias("before"))
    return spread.withColumn("own", F.row_number().over(W.partitionBy(by, "bucket").orderBy(key)) - 1).join(offsets, [by, "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("bucket", "own", "before")


def planned(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> tuple[DataFrame, Plan]:
    """(id, part, tokens, container) for every item, and the plan; ``part`` numbers the pieces of a divided item."""
    spark = sizes.sparkSession
    c = F.lit(capacity)
    once = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n"))
    once = materialise(once.select("id", F.coalesce("n", F.lit(0)).alias("n")))
    whole = F.floor(F.col("n") / c).cast("long")
    full = once.where(F.col("n") >= capacity).select("id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"), c.cast("long").alias("length"))
    rest = once.where(F.col("n") % c > 0).select("id", whole.alias("part"), (F.col("n") % c).alias("length"))
    nothing = once.where("n = 0").select("id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container"))

    parts = full.union(rest)
    histogram = {r.length: r.m for r in rest.groupBy("length").agg(F.count("*").alias("m")).collect()}  # at most ``capacity`` rows
    n_full = full.count()
    told = plan(histogram, capacity)
    table = intervals(([({capacity: 1}, n_full)] if n_full else []) + told.chosen)
    shared = spark.sparkContext.broadcast({k: g[["first", "last", "per", "base"]].to_numpy() for k, g in table.groupby("length")})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.empty(len(b), np.int64)
            for length, at in b.groupby("length").indices.items():
                spans = shared.value[length]
                r = b["rank"].to_numpy()[at]
                k = np.searchsorted(spans[:, 0], r, side="right") - 1
                container[at] = spans[k, 3] + (r - spans[k, 0]) // spans[k, 2]
            yield pd.DataFrame({"id": b["id"], "part": b["part"], "tokens": b["length"], "container": container})

    keyed = parts.withColumn("key", F.struct("id", "part"))
    id_type = dict(once.dtypes)["id"]
    placed = ranked(keyed, "length", "key").select("id", "part", "length", "rank").mapInPandas(place, f"id {id_type}, part long, tokens long, container long")
    return placed.union(nothing), told


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    return planned(sizes, capacity, id_col, size_col)[0]


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    return pack(with_tokens(docs, id_col, text_col, tokenizer), capacity, id_col).withColumnRenamed("id", id_col)


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, items, tokens, filled, fullest): how well the capacity is used."""
    boxes = packed.where("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("filled"), F.max("tokens").alias("fullest"))


def usage_report(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    """``usage`` with what the LP gave: bound and LP value (containers, of the divided rests), items by LP configurations, items that closed gaps."""
    packed, told = planned(with_tokens(docs, id_col, text_col, tokenizer), capacity, id_col)
    return usage(packed, capacity).select("*", F.lit(told.bound).alias("bound"), F.lit(told.lp_value).alias("lp_value"), F.lit(told.lp_items).alias("lp_items"), F.lit(told.mended_items).alias("mended_items"))


def invariants(packed: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(documents, over_capacity, repeated_parts, needlessly_divided): the last three are 0 in a right packing."""
    once = packed.groupBy(F.col(id_col).alias("id")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.count_distinct("part").alias("different"))
    items = once.agg(F.count("*").alias("documents"), F.count_if(F.col("parts") > F.col("different")).alias("repeated_parts"), F.count_if(F.col("parts") > F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))).alias("needlessly_divided"))
    full = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > capacity).alias("over_capacity"))
    return items.crossJoin(full).select("documents", "over_capacity", "repeated_parts", "needlessly_divided")  # one row each
