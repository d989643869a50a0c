"""Reproducible sample stable as data grows.

A record is chosen if the Feistel permutation of its identifier's number lies under
``rate * domain size``. Nothing but the identifier enters: the choice is the same on
every run and layout, and records that arrive later change no earlier choice. The
permutation is a bijection of the domain [0, 2**120), so different numbers never share
a place, and it is evaluated as column arithmetic: no state, no shuffle.

Numbers: a whole number is its own number. A string has the first 120 bits of the MD5
of all its bytes; ``collisions`` counts the identifiers that share a number, which is to
be expected once in 2**120 pairs, and ``stable_sample`` raises on any with ``check``.
A number is kept as two halves of 60 bits; as the rate is taken to a multiple of 2**-60, the
upper half of the permuted number (``place``) decides.

Defined cases: null identifiers are never chosen; repeated rows of an identifier are
chosen together (one row each with ``distinct``); rate 0 chooses none, rate 1 all
but null; an empty table gives an empty sample; extra columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 60
MASK = (1 << HALF) - 1
SIDE = 1 << HALF  # values of one half
LOW = (1 << 30) - 1
FACTORS = (1_013_904_223, 879_190_747)  # odd and below 2**30


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    raw = [hashlib.sha256(f"{seed}:{r}".encode()).digest() for r in range(rounds)]
    return [(int.from_bytes(d[:4], "big") & LOW, int.from_bytes(d[4:8], "big") & LOW) for d in raw]


def number_of(id_col: Column, integral: bool = False) -> Column:
    """Place of an identifier in the numeric domain, as a struct of its halves."""
    if integral:
        n = id_col.cast("long")
        halves = F.struct(F.shiftrightunsigned(n, HALF).alias("l"), n.bitwiseAND(F.lit(MASK)).alias("r"))
    else:
        digest = F.md5(id_col)
        half = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
        halves = F.struct(half(1).alias("l"), half(16).alias("r"))
    return F.when(id_col.isNotNull(), halves)


def permuted(number: Column, seed: int = 17, rounds: int = 8) -> Column:
    """Feistel permutation of the domain, as a struct of halves: a fold over the round keys, so each half is evaluated once a round."""

    def turn(acc: Column, key: Column) -> Column:
        left, right = acc["l"], acc["r"]
        # each product is below 2**60
        mixed = right.bitwiseAND(F.lit(LOW)).bitwiseXOR(key["a"]) * F.lit(FACTORS[0]) + F.shiftright(right, 30).bitwiseXOR(key["b"]) * F.lit(FACTORS[1])
        return F.aggregate(
            F.array(mixed),
            F.struct(right.alias("l"), right.alias("r")),
            lambda _, m: F.struct(right.alias("l"), left.bitwiseXOR(m.bitwiseXOR(F.shiftright(m, 31))).bitwiseAND(F.lit(MASK)).alias("r")),
        )

    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(seed, rounds)])
    return F.aggregate(keys, number, turn)


def place_of(id_col: Column, seed: int = 17, integral: bool = False) -> Column:
    """Upper half of the permuted number of an identifier."""
    return permuted(number_of(id_col, integral), seed)["l"]


def permuted_sql(source: str, seed: int = 17, rounds: int = 8) -> str:
    """(id, place) of the string identifiers of ``source``: the same permutation as nested SQL."""
    sql = f"SELECT id, ('0x' || substr(md5(id), 1, 15))::BIGINT AS l, ('0x' || substr(md5(id), 16, 15))::BIGINT AS r FROM ({source})"
    for a, b in round_keys(seed, rounds):
        sql = f"SELECT id, l, r, xor(r & {LOW}, {a}) * {FACTORS[0]} + xor(r >> 30, {b}) * {FACTORS[1]} AS m FROM ({sql})"
        sql = f"SELECT id, r AS l, xor(l, xor(m, m >> 31)) & {MASK} AS r FROM ({sql})"
    return f"SELECT id, l AS place FROM ({sql})"


def collisions(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(l, r, ids): numbers shared by different identifiers."""
    integral = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    c = F.col(id_col) if integral else F.col(id_col).cast("string")
    numbered = df.where(F.col(id_col).isNotNull()).select(c.alias("id"), number_of(c, integral).alias("n")).distinct()
    return numbered.groupBy("n.l", "n.r").agg(F.count("*").alias("ids")).where("ids > 1")


def stable_sample(df: DataFrame, rate: float, id_col: str = "id", seed: int = 17, place_col: str | None = None, check: bool = False) -> DataFrame:
    """Rows of ``df`` whose identifier is chosen; ``place_col`` adds the place, ``check`` raises if identifiers share a number."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    if check and not collisions(df, id_col).isEmpty():
        raise ValueError("different identifiers share a number")
    integral = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    place = place_of(F.col(id_col) if integral else F.col(id_col).cast("string"), seed, integral)
    kept = df.where(place < F.lit(int(rate * SIDE)))
    return kept.withColumn(place_col, place) if place_col else kept
