"""Operator 9: reproducible shuffle by a Feistel permutation with cycle walking.

Rows get global numbers 0..n-1 in the order of doc_id. A keyed four-round
Feistel network over the least sufficient number of bits permutes them; a
result of n or more is permuted again until it falls below n, which keeps the
map one to one. Shard and slot follow from the permuted number alone, and
``unpermute`` finds the row number back: nothing needs to be stored.

Defined results:

* Null ids are numbered last. Rows with equal ids get neighbouring numbers, in any order
  (the result carries the id alone, so it is the same).
* Empty table: empty result. One row: shard 0, slot 0. Only doc_id is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, maybe_broadcast, pick

SHARDS = 64
KEY = 20240229
ROUNDS = 4
_M31 = (1 << 31) - 1


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    out, x = [], key & _M31
    for _ in range(rounds):
        x = (x * 1103515245 + 12345) & _M31
        out.append(x)
    return out


def bits_for(n: int) -> tuple[int, int]:
    """Bits of the left and right half of a domain of at least n values."""
    b = max(2, (n - 1).bit_length())
    return b // 2, b - b // 2


def _f(right: np.ndarray, k: int, bits: int) -> np.ndarray:
    x = ((right ^ k) * 1597334677) & _M31
    x ^= x >> 15
    x = (x * 812015047) & _M31
    x ^= x >> 13
    return x & ((1 << bits) - 1)


def _once(v: np.ndarray, keys: list[int], lb: int, rb: int) -> np.ndarray:
    for i, k in enumerate(keys):
        # halves of unequal size: rounds change the left and the right half in turn
        left, right = v >> rb, v & ((1 << rb) - 1)
        if i % 2:
            right = right ^ _f(left, k, rb)
        else:
            left = left ^ _f(right, k, lb)
        v = (left << rb) | right
    return v


def _walk(v: np.ndarray, n: int, keys: list[int], lb: int, rb: int, step) -> np.ndarray:
    v = step(v, keys, lb, rb)
    out = np.flatnonzero(v >= n)
    while len(out):
        v[out] = step(v[out], keys, lb, rb)
        out = out[v[out] >= n]
    return v


def permute(rows: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permuted numbers of these row numbers, out of 0..n-1."""
    return _walk(np.asarray(rows, np.int64), n, round_keys(key), *bits_for(n), _once)


def _back(v: np.ndarray, keys: list[int], lb: int, rb: int) -> np.ndarray:
    for i in reversed(range(len(keys))):
        left, right = v >> rb, v & ((1 << rb) - 1)
        if i % 2:
            right = right ^ _f(left, keys[i], rb)
        else:
            left = left ^ _f(right, keys[i], lb)
        v = (left << rb) | right
    return v


def unpermute(positions: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    return _walk(np.asarray(positions, np.int64), n, round_keys(key), *bits_for(n), _back)


def number_rows(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The frame with _row, a dense global number in the order of the column, and the number of rows.

    Range partitions are sorted and counted; no row passes through one task.
    """
    parts = ids.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    kept = cut(parts.withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.select(column, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    base = ids.sparkSession.createDataFrame(starts, "_part bigint, _base bigint")
    return kept.join(maybe_broadcast(base, len(starts), 16), "_part").select(column, (F.col("_base") + F.col("_in")).alias("_row")), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """(doc_id, row_number, position, shard, slot) of every row."""
    rows, n = number_rows(pick(docs, doc_id="doc_id:bigint"), "doc_id")

    @F.pandas_udf("bigint")
    def position(v: pd.Series) -> pd.Series:
        return pd.Series(permute(v.to_numpy(), n, key))

    out = rows.select("doc_id", F.col("_row").alias("row_number"), position("_row").alias("position"))
    return out.select("*", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))
