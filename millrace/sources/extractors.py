"""Question extractors: one registered projection per kind of source table.

Each takes the source's rows (with an order column ``i``) and gives question, gold and
metadata; rows that break a source's guard are dropped. All are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(*names: str):
    def register(f):
        for name in names:
            EXTRACTORS[name] = f
        return f

    return register


def _letter(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, X.LETTERS)), i)


def _choice(df: DataFrame, question: Column, options: Column, index: Column) -> DataFrame:
    ok = question.isNotNull() & (F.size(options) > 1) & (index >= 0) & (index < F.size(options))
    return df.where(F.coalesce(ok, F.lit(False))).select("i", X.format_mc(question, options).alias("question"), _letter(index).alias("gold"))


def _plain(df: DataFrame, question: Column, gold: Column) -> DataFrame:
    q = X.present(question)
    return df.where(q.isNotNull()).select("i", q.alias("question"), gold.cast("string").alias("gold"))


@extractor("mmlu_aux", "mmlu_pro", "openbookqa_indexed")
def indexed_choice(df: DataFrame) -> DataFrame:
    """question, options, answer (a whole number)."""
    return _choice(df, F.col("question"), F.col("options"), F.col("answer").try_cast("int"))


@extractor("arc_challenge", "arc_easy", "openbookqa")
def labelled_choice(df: DataFrame) -> DataFrame:
    """question, texts, labels, key: the answer is where the key stands among the labels."""
    return _choice(df.where(F.size("texts") == F.size("labels")), F.col("question"), F.col("texts"), (F.array_position("labels", F.col("key")) - 1).cast("int"))


@extractor("hellaswag")
def endings(df: DataFrame) -> DataFrame:
    """context, endings (four), label (as text)."""
    rows = df.where(F.size("endings") == 4)
    return _choice(rows, F.concat(F.lit("Complete the following:\n"), F.trim("context")), F.col("endings"), F.col("label").try_cast("int"))


@extractor("piqa")
def two_solutions(df: DataFrame) -> DataFrame:
    rows = df.where(X.present(F.col("sol1")).isNotNull() & X.present(F.col("sol2")).isNotNull())
    return _choice(rows, F.col("goal"), F.array("sol1", "sol2"), F.col("label").try_cast("int"))


@extractor("siqa")
def social(df: DataFrame) -> DataFrame:
    """context, question, answers (three), label 1 to 3."""
    rows = df.where(F.size("answers") == 3)
    return _choice(rows, X.with_context(F.col("context"), F.col("question")), F.col("answers"), F.col("label").try_cast("int") - 1)


@extractor("gsm8k")
def worked_number(df: DataFrame) -> DataFrame:
    gold = X.final_number(F.col("answer"))
    return _plain(df.where(gold.isNotNull()), F.col("question"), gold)


@extractor("math")
def boxed_by_level(df: DataFrame, levels: list[int] | None = None) -> DataFrame:
    level = F.trim(F.replace(F.col("level"), F.lit("Level"), F.lit(""))).try_cast("int")
    ok = level.isin(levels) if levels else level.isNotNull()
    gold = X.boxed(F.col("solution"))
    return _plain(df.where(ok & gold.isNotNull()), F.col("problem"), gold)


@extractor("metamathqa")
def said_number(df: DataFrame) -> DataFrame:
    kind = F.lower("type")
    derived = F.contains(kind, F.lit("math")) & ~F.contains(kind, F.lit("gsm"))
    gold = X.said_answer(F.col("response"))
    return _plain(df.where(~derived & gold.isNotNull()), F.col("query"), gold)


@extractor("asdiv")
def number_or_text(df: DataFrame) -> DataFrame:
    return _plain(df.where(F.col("result").isNotNull()), X.with_context(F.col("body"), F.col("question")), F.coalesce(X.plain_number(F.col("result").try_cast("decimal(20,6)")), F.col("result")))


@extractor("ifeval_train", "codealpaca", "magicoder")
def first_prompt(df: DataFrame) -> DataFrame:
    keys = [c for c in ("prompt", "instruction", "problem", "query") if c in df.columns]
    return _plain(df, X.first_present(*[F.col(c) for c in keys]), F.lit(None))


@extractor("norobots")
def first_user(df: DataFrame) -> DataFrame:
    """messages: the first user message of at least two."""
    users = F.filter("messages", lambda m: m["role"] == "user")
    return _plain(df.where(F.size("messages") >= 2), F.get(users, F.lit(0))["content"], F.lit(None))


@extractor("tulu3")
def single_turn(df: DataFrame) -> DataFrame:
    m = F.col("messages")
    ok = (F.size(m) == 2) & (F.get(m, F.lit(0))["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant")
    return _plain(df.where(F.coalesce(ok, F.lit(False))), F.get(m, F.lit(0))["content"], F.lit(None))


@extractor("openhermes")
def opening_human(df: DataFrame) -> DataFrame:
    first = F.get("conversations", F.lit(0))
    return _plain(df.where(first["from"].isin("human", "user")), first["value"], F.lit(None))


@extractor("oasst_top")
def first_of_tree(df: DataFrame) -> DataFrame:
    """First prompter message of each tree that passes the language rule."""
    from millrace.operators.relational import first

    ok = (F.col("role") == "prompter") & (X.present(F.col("lang")).isNull() | (F.col("lang") == "en")) & X.present(F.col("text")).isNotNull()
    return _plain(first(df.where(ok).select("tree", "i", "text"), ["tree"], [F.col("i")]), F.col("text"), F.lit(None))


@extractor("xlam")
def tools(df: DataFrame) -> DataFrame:
    q = X.present(F.col("query"))
    return df.where(q.isNotNull()).select("i", F.concat(q, F.lit("\n\nTools:\n"), F.coalesce("tools", F.lit("[]"))).alias("question"), F.col("answers").alias("gold"))


@extractor("glaive_fc")
def function_chat(df: DataFrame) -> DataFrame:
    turn = X.first_user_turn(F.col("chat"))
    return _plain(df.where(turn.isNotNull()), X.with_context(F.col("system"), turn), F.lit(None))


@extractor("narrativeqa")
def long_document(df: DataFrame) -> DataFrame:
    ok = X.present(F.col("document")).isNotNull() & X.present(F.col("question")).isNotNull()
    return _plain(df.where(ok), X.with_context(F.col("document"), F.col("question")), F.get("answers", F.lit(0)))


@extractor("hotpotqa")
def many_passages(df: DataFrame) -> DataFrame:
    rows = df.where((F.size("titles") > 0) & X.present(F.col("question")).isNotNull())
    return _plain(rows, X.with_context(X.passages(F.col("titles"), F.col("sentences")), F.col("question")), F.col("answer"))


def extract_all(sources: dict[str, DataFrame], registry: DataFrame, category: str | None = None, source: str | None = None, limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Questions of all registered sources (registry: source, category, extractor) and what was skipped and why."""
    from functools import reduce

    from pyspark.sql import Window as W

    chosen = registry
    if category:
        chosen = chosen.where(F.col("category") == category)
    if source:
        chosen = chosen.where(F.col("source") == source)
    out, skipped = [], {}
    for r in chosen.orderBy("source").collect():  # one row a source
        if r.extractor not in EXTRACTORS:
            skipped[r.source] = "no extractor"
        elif r.source not in sources:
            skipped[r.source] = "no table"
        else:
            q = EXTRACTORS[r.extractor](sources[r.source])
            if limit is not None:
                q = q.orderBy("i").limit(limit)
            idx = F.row_number().over(W.partitionBy(F.lit(r.source)).orderBy("i")) - 1
            out.append(q.select(X.record_id(F.lit(r.category), F.lit(r.source), idx).alias("id"), F.lit(r.category).alias("category"), F.lit(r.source).alias("source"), "question", "gold"))
    return (reduce(DataFrame.unionByName, out) if out else None), skipped
