"""Next-fit packing of token sequences into fixed blocks, one deterministic shard at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def pack_blocks(examples: DataFrame, key: str, ids: str, mask: str, block: int, pad: int, shards: int, longer: str = "cut") -> DataFrame:
    """(shard, block_no, input_ids, labels, position_ids), each list exactly ``block`` long.

    An example longer than a block is cut to it (``longer="cut"``, as training on whole blocks has
    it; ``cut_tokens`` counts what that loses) or goes on in blocks of its own (``"split"``); positions start anew with each example;
    labels are ``IGNORED`` where the mask is 0 and in the padding. ``shards`` fixes the
    result and bounds what one task holds.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, x, y, p = [], [], [], []

        def close() -> None:
            n = block - len(x)
            rows.append((int(pdf["shard"].iloc[0]), len(rows), [*x, *[pad] * n], [*y, *[IGNORED] * n], [*p, *[0] * n]))
            x.clear(), y.clear(), p.clear()

        for t, m in zip(pdf.sort_values(key)[ids], pdf.sort_values(key)[mask], strict=True):
            for s in range(0, len(t) if longer == "split" else min(len(t), 1), block):
                u, v = list(t)[s : s + block], list(m)[s : s + block]
                if x and len(x) + len(u) > block:
                    close()
                x += u
                y += [a if b else IGNORED for a, b in zip(u, v, strict=True)]
                p += range(len(u))
        if x:
            close()
        return pd.DataFrame(rows, columns=["shard", "block_no", "input_ids", "labels", "position_ids"])

    sharded = examples.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(pack, "shard int, block_no int, input_ids array<int>, labels array<int>, position_ids array<int>")


def cut_tokens(examples: DataFrame, ids: str, block: int) -> DataFrame:
    """(examples, tokens): examples longer than a block, and their tokens beyond it."""
    over = F.greatest(F.size(ids) - block, F.lit(0))
    return examples.agg(F.count_if(over > 0).alias("examples"), F.coalesce(F.sum(over), F.lit(0)).alias("tokens"))


def packing_report(blocks: DataFrame) -> DataFrame:
    """(blocks, trained share, padding share is what is left of the position-less rest)."""
    kept = F.aggregate("labels", F.lit(0), lambda a, x: a + (x != IGNORED).cast("int"))
    return blocks.agg(F.count("*").alias("blocks"), (F.sum(kept) / F.sum(F.size("labels"))).alias("trained"))
