"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix (operator 9).

The rows are first dealt by a hash into PARTS source parts. A matrix says how many rows each part sends to
each fine shard; it is drawn from the multivariate hypergeometric distribution, so that its margins are
exact and it is distributed as under a uniform shuffle of all rows. Each part ranks its rows by a random
key (the local permutation) and cuts the ranks at the matrix's cumulative counts (the exchange); each fine
shard ranks what it got by a second random key. A shard is a run of fine shards whose sizes are known
beforehand, so a row's slot needs no further count.

Only the counts of the parts come to the driver and only the matrix goes back: PARTS by at most PARTS and a
shard's worth of numbers, whatever the rows. A part or fine shard of twice ROWS rows or more is ranked in
ranges of its random keys: counts of the ranges, added up, tell the ranks at which they begin, so that the
rows a task sorts don't grow with the table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source parts, and fine shards at most (or as many as shards); rows of a range that is ranked at once.
PARTS = 512
ROWS = 1024
SEED = 20240


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn out of good + bad are good; for counts too large for numpy's own sampler.

    Inverts the distribution over 40 standard deviations around its mode, relative weights in logarithms.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    lo, hi = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    a, b = max(lo, mode - int(40 * sd) - 2), min(hi, mode + int(40 * sd) + 2)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    weights = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))


def deal(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A draw of ``n`` rows without replacement from shards with ``left`` free places."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest = np.zeros_like(left), int(left.sum())
    for k, free in enumerate(map(int, left)):
        rest -= free
        out[k] = hypergeometric(rng, free, rest, n) if n else 0
        n -= int(out[k])
    return out


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[np.ndarray]:
    """A row of fine-shard counts for each part; rows sum to ``counts`` and columns to ``sizes``."""
    rng, left, rows = np.random.default_rng(seed), np.array(sizes, dtype=np.int64), []
    for n in counts:
        rows.append(deal(rng, left, n))
        left = left - rows[-1]
    return rows


def fine_sizes(n: int, shards: int, fine: int) -> list[int]:
    """Sizes of the fine shards, ``fine`` to a shard: shard sizes, and those in a shard, differ by one at most."""
    out: list[int] = []
    for k in range(shards):
        size = n // shards + (k < n % shards)
        out += [size // fine + (j < size % fine) for j in range(fine)]
    return out


def _ranked(df: DataFrame, group: str, key: Column, ties: list[str], largest: int, name: str) -> DataFrame:
    """``df`` with the rank, from 1, of each row in its group by a hash key that is spread evenly.

    Groups of up to ``largest`` rows are cut by the key's leading bits into ranges of ROWS rows or up to twice as many.
    """
    bits = max(0, math.floor(math.log2(max(1, largest) / ROWS)))
    within = [F.col(group)]
    if bits:
        df = df.withColumn("__sub", F.shiftrightunsigned(key, 64 - bits))
        counts = df.groupBy(group, "__sub").agg(F.count("*").alias("__here"))
        upto = Window.partitionBy(group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select(group, "__sub", F.coalesce(F.sum("__here").over(upto), F.lit(0)).alias("__before"))
        df = df.join(before, [group, "__sub"])
        within.append(F.col("__sub"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(key, *ties)).cast("long")
    return df.withColumn(name, rank + F.col("__before") if bits else rank).drop("__sub", "__before")


def _place(ends: Column, rank: Column, size: int) -> Column:
    """How many of the ascending ``ends`` are below the rank, by halving."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    below = lambda at, step: F.coalesce(F.get(ends, at + step - 1) < rank, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(0))


def shuffled(df: DataFrame, ident: list[str], shards: int = 40, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``ident`` names the columns that tell rows apart; rows equal in all of them are interchangeable, and
    which of them gets which place is not defined. Nulls are values like any other; very long values are
    only hashed and carried along. An empty table gives an empty result. Columns ``shard`` and ``slot`` of
    the input are replaced; all others are kept, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.xxhash64(F.lit(seed), *ident).alias("__p"), F.xxhash64(F.lit(seed + 1), *ident).alias("__h"), F.struct(*names).alias("__row"))
    rows = rows.withColumn("__p", F.pmod("__p", F.lit(PARTS)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}
    n, here = sum(counts.values()), sorted(counts)
    fine = max(1, min(PARTS, math.ceil(n / ROWS)) // shards)
    sizes = fine_sizes(n, shards, fine)
    matrix = communication_matrix([counts[p] for p in here], sizes, seed)
    schema = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))])
    ends = df.sparkSession.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in zip(here, matrix, strict=True)], schema)
    starts, at = [], 0
    for k, size in enumerate(sizes):
        at = 0 if k % fine == 0 else at
        starts.append(at)
        at += size
    ties = [f"__row.{c}" for c in ident]
    ranked = _ranked(rows, "__p", F.col("__h"), ties, max(counts.values(), default=0), "__r")
    # At most PARTS rows of as many numbers are broadcast.
    sent = ranked.join(F.broadcast(ends), "__p").withColumn("__fine", _place(F.col("__ends"), F.col("__r"), len(sizes))).drop("__ends")
    sent = sent.withColumn("__h", F.xxhash64(F.lit(seed + 2), "__p", "__r"))
    again = _ranked(sent, "__fine", F.col("__h"), ["__p", "__r"], max(sizes), "__again")
    start = F.array(*map(F.lit, starts)) if len(starts) <= 64 else F.from_json(F.lit(str(starts)), T.ArrayType(T.LongType()))
    return again.select(
        *[F.col("__row")[c].alias(c) for c in names],
        F.floor(F.col("__fine") / fine).cast("int").alias("shard"),
        (F.get(start, F.col("__fine")) + F.col("__again") - 1).cast("long").alias("slot"),
    )


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """The contract's columns for every document.

    A null text has size 16 and a null checksum; an empty one has size 16 and checksum 0. Null or repeated
    doc_ids are rows like any other.
    """
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text")).alias("text_crc32")
    )
    return shuffled(slim, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, as shuffled() gives them; rows are told apart by id and text."""
    packed = docs.select("doc_id", F.crc32(F.col("text")).alias("crc"), F.struct("*").alias("row"))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    out = shuffled(packed, ["doc_id", "crc"], shards, seed)
    return out.select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")
