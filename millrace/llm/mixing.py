"""Mixing sources to target weights: hierarchical budgeting and seeded epochs.

The leaves of the tree are (domain, language, source). A source's target share is laid
on its leaves in proportion to their tokens, and weights add up through languages and
domains to the root. The budget goes down the tree by weight; a leaf gives at most its
tokens times ``max_repeats`` of its source. What a leaf cannot give goes to its
siblings (other sources of the same domain and language) in proportion to their
weights, what they cannot take to the other languages of the domain, then to the other
domains. A listed source without documents leaves its share to all.

Each leaf's budget is whole epochs of all its documents plus a prefix of the next
epoch in the seeded order of that epoch: the prefix ends before or after the document
that crosses the budget, whichever is nearer. The prefix is found in two steps - tokens
per (leaf, slice of the order), then running sums inside the one slice that crosses -
so a leaf with a third of all documents is never in one task.

Only the table of leaves goes to the driver; its size is checked (``most_leaves``).

Defined cases: null texts and texts without tokens are not used; spellings of a source
are one source, missing labels are ``unknown``; sources not listed and listed sources
with a null or non-positive share give nothing; null ``max_repeats`` is 1; a source
listed twice has the sum of its shares and the larger cap; an empty table gives no
rows; repeated rows of an id count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.labels import domain_label, lang_label, source_label
from millrace.llm.tokenizers import DEFAULT, with_tokens
from millrace.session import materialise

LEVELS = ("domain", "lang", "source")
SLICES = 1024


def water_fill(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Split a budget by weight; what exceeds a cap goes to the others by weight."""
    got = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and caps[i] > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if budget * weights[i] / total >= caps[i]]
        if not full:
            for i in open_:
                got[i] = budget * weights[i] / total
            break
        for i in full:
            got[i] = caps[i]
        budget -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(leaves: list[dict], total: float) -> dict[tuple, float]:
    """Tokens each leaf has to give; leaves have domain, lang, source, weight and cap."""
    out: dict[tuple, float] = {}

    def down(members: list[dict], depth: int, budget: float) -> None:
        if depth == len(LEVELS):
            out[tuple(members[0][k] for k in LEVELS)] = budget
            return
        children: dict[str, list[dict]] = {}
        for leaf in members:
            children.setdefault(leaf[LEVELS[depth]], []).append(leaf)
        names = sorted(children)
        split = water_fill(budget, [sum(x["weight"] for x in children[n]) for n in names], [sum(x["cap"] for x in children[n]) for n in names])
        for n, b in zip(names, split, strict=True):
            down(children[n], depth + 1, b)

    if leaves:
        down(leaves, 0, total)
    return out


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT, most_leaves: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents: (id, source, lang, domain, n_tokens, uses) of every document used;
    shares: one row per listed source with its target and actual share.
    ``total_tokens`` defaults to one pass of all listed sources.
    """
    spark = docs.sparkSession
    wanted = (
        targets.select(source_label(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
        .where("share > 0 AND NOT isnan(share)")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    )
    listed = {r.source: (r.share, max(1, r.cap)) for r in wanted.limit(most_leaves + 1).collect()}
    if len(listed) > most_leaves:
        raise ValueError(f"more than {most_leaves} sources are listed")
    labelled = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source_label(F.col("source")).alias("source"), lang_label(F.col("lang")).alias("lang"), domain_label(F.col("domain")).alias("domain"))
    sized = with_tokens(labelled.join(wanted.select("source"), "source", "left_semi"), "id", "text", tokenizer, keep=LEVELS).where("n_tokens > 0")
    sized = materialise(sized.groupBy("id").agg(F.max(F.struct("n_tokens", *LEVELS)).alias("d")).select("id", "d.*"))

    leaf_rows = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).limit(most_leaves + 1).collect()
    if len(leaf_rows) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves (domain, lang, source)")
    per_source: dict[str, int] = {}
    for r in leaf_rows:
        per_source[r.source] = per_source.get(r.source, 0) + r.tokens
    total = total_tokens if total_tokens is not None else sum(per_source.values())
    leaves = [{**{k: r[k] for k in LEVELS}, "tokens": r.tokens, "weight": listed[r.source][0] * r.tokens / per_source[r.source], "cap": float(r.tokens * listed[r.source][1])} for r in leaf_rows]
    given = budgets(leaves, float(total))
    plan = []
    for leaf in leaves:
        key = tuple(leaf[k] for k in LEVELS)
        budget = given.get(key, 0.0)
        epochs = min(int(budget // leaf["tokens"]), listed[leaf["source"]][1])
        rest = budget - epochs * leaf["tokens"] if epochs < listed[leaf["source"]][1] else 0.0
        plan.append((*key, epochs, float(rest)))
    planned = spark.createDataFrame(plan, "domain string, lang string, source string, epochs int, rest double")

    # the seeded order of the epoch that is only begun
    order = F.xxhash64(F.lit(seed), "epochs", "id")
    placed = sized.join(planned, list(LEVELS)).withColumn("order", order).withColumn("slice", F.shiftrightunsigned("order", 54).cast("int"))
    placed = placed.withColumn("order", F.expr("order ^ -9223372036854775808"))  # unsigned order, as the slices have it
    slices = placed.where("rest > 0").groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("m"))
    running = F.coalesce(F.sum("m").over(W.partitionBy(*LEVELS).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bounds = slices.select(*LEVELS, "slice", running.alias("before"), "m")
    told = placed.join(bounds, [*LEVELS, "slice"], "left")
    crossing = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("m") > F.col("rest"))
    inside = told.where(crossing)
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS, "slice").orderBy("order", "id").rowsBetween(W.unboundedPreceding, 0))
    # a document is taken if more than half of it lies within the budget
    cut = inside.withColumn("upto", upto).withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 < F.col("rest")).cast("int")).drop("upto")
    clear = told.where(~F.coalesce(crossing, F.lit(False))).withColumn("more", (F.coalesce(F.col("before") + F.col("m") <= F.col("rest"), F.lit(False)) & (F.col("rest") > 0)).cast("int"))
    columns = ["id", "source", "lang", "domain", "n_tokens"]
    used = clear.unionByName(cut).select(*columns, (F.col("epochs") + F.col("more")).alias("uses")).where("uses > 0")

    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
    whole = F.sum("tokens").over(W.partitionBy())
    rows = wanted.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats")).join(reached, "source", "left")
    shares = rows.select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"),
    )
    return used, shares
