"""Operator 1: nearest neighbours by a permutation index.

Pivots are the ``pivots`` distinct vectors of the least hashes. A vector is
represented by its ``prefix`` nearest pivots in their order and posted, with
each one's place, in that pivot's inverted file. A query reads the files of its
own pivots and ranks the vectors that it meets there by the footrule distance
of the two orders, in which a pivot that one of them lacks counts as its place
``prefix``: the sum over shared pivots of ``prefix`` less the later place, from
the greatest on. The best are reranked by Euclidean distance.

The index is partitioned by vectors: a shard of about ``tile`` of them, chosen
by hash, holds inverted files of its own. In all ``depth`` times the root of
the number of distinct vectors are reranked for a query, an even share of them
in each shard and six standard deviations more, so that the best by footrule
over the whole table are among them but once in some 10**8 times. Queries are
the rows whose id is divisible by ``every``, sent to the shards in blocks of
``tile``; what a task holds is bounded by these two sizes, whatever the table's.

Defined results:

* Null, empty, infinite or NaN-holding vectors, as 32-bit numbers, and vectors with a null part are neither queries nor neighbours.
* Each length of vectors is indexed by itself: neighbours have the query's length.
* Equal vectors collapse to one in the index; each copy is a neighbour, at distance 0, of the others.
* Rows with equal id and vector are one row. Null ids aren't queries, but neighbours like others.
* Ties of distance: the lesser id first, null last. A row with fewer than ``k`` candidates gets fewer neighbours.
* Empty table: empty result. Other columns, whatever their names, aren't read.
* Vectors are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import cut, hide

K = 10
EVERY = 100
PIVOTS = 512
PREFIX = 128
DEPTH = 5
TILE = 16_384
SCHEMA = "vec_id bigint, rank int, neighbor_id bigint, distance double"


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties by the pivots' order."""
    gap = (pivots * pivots).sum(1)[None] - 2 * (vectors @ pivots.T)
    prefix = min(prefix, len(pivots))
    near = np.sort(np.argpartition(gap, prefix - 1, axis=1)[:, :prefix], axis=1)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(gap, near, 1), axis=1, kind="stable"), 1).astype(np.int16)


class Files:
    """The inverted files of a shard: for each pivot the vectors posted there and the pivot's places in their orders."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        self.size, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.member, self.place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int16)

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """Of every vector, what its footrule distance from the query falls short of the greatest, halved."""
        lo, hi = self.bounds[order], self.bounds[order + 1]
        many = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        mine = np.repeat(np.arange(self.prefix, dtype=np.int16), many)
        return np.bincount(self.member[at], self.prefix - np.maximum(mine, self.place[at]), self.size)


def best(score: np.ndarray, many: int, key: np.ndarray) -> np.ndarray:
    """The ``many`` greatest scores above 0; ties by the lesser key."""
    found = np.flatnonzero(score > 0)
    if len(found) > many:
        edge = np.partition(score[found], len(found) - many)[len(found) - many]
        sure, tied = found[score[found] > edge], found[score[found] == edge]
        found = np.concatenate([sure, tied[np.argsort(key[tied], kind="stable")[: many - len(sure)]]])
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _search(held, prefix: int, share: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        q, x = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if q.num_rows and x.num_rows:
            centres = held.value
            qkey, key, qvec, vec = q.column("key").to_numpy(), x.column("key").to_numpy(), _matrix(q.column("vec")), _matrix(x.column("vec"))
            # null ids last
            late, least = x.column("id").is_null().to_numpy(), x.column("id").fill_null(0).to_numpy()
            files = Files(orders(vec, centres, prefix), len(centres))
            for i, order in enumerate(orders(qvec, centres, prefix)):
                near = best(files.closeness(order.astype(np.int64)), share, key)
                near = near[key[near] != qkey[i]]
                gap = vec[near].astype(float) - qvec[i].astype(float)
                far = np.sqrt((gap * gap).sum(1))
                top = np.lexsort((key[near], least[near], late[near], far))[:k]
                for part, value in zip(out, (np.full(len(top), qkey[i]), key[near[top]], far[top])):
                    part.append(value)
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(("q", "key", "distance"), out)})

    return run


def neighbours(
    vectors: DataFrame, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, depth: float = DEPTH, every: int = EVERY, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): up to ``k`` nearest rows, rank from 1, of every row whose id is divisible by ``every``."""
    plain, where = hide(vectors)
    rows = plain.select(F.col(where[id_col]).cast("bigint").alias("id"), F.col(where[vector_col]).cast("array<float>").alias("vec"))
    rows = rows.where((F.size("vec") > 0) & ~F.exists("vec", lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf"))))
    # -0.0 equals 0.0
    rows = rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")).alias("vec")).withColumn("key", F.xxhash64("vec"))
    # copies meet before anything is collected
    place = F.struct(F.isnull("id").alias("late"), "id")
    distinct = cut(rows.groupBy("key").agg(F.first("vec").alias("vec"), F.min(place)["id"].alias("id")))
    ids = rows.select("key", "id").distinct()
    queries = cut(ids.where(F.pmod("id", F.lit(every)) == 0))
    asking = queries.select("key").distinct()
    out = None
    for dim, n in distinct.groupBy(F.size("vec")).count().collect():  # a row a length
        found = _one_length(distinct.where(F.size("vec") == dim), n, asking, k, pivots, prefix, depth, tile)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    order = W.partitionBy("q").orderBy("distance", F.col("late"), F.col("least"), "key")
    ranked = out.join(distinct.select("key", F.isnull("id").alias("late"), F.col("id").alias("least")), "key").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    near = ranked.select("q", "distance", "key").unionByName(asking.select(F.col("key").alias("q"), F.lit(0.0).alias("distance"), "key"))
    # of each copied vector, as many of the least ids as one row can have as neighbours
    few = W.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    named = ids.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select("key", "id")
    pool = near.join(named, "key").select("q", "distance", F.col("id").alias("neighbor_id"))
    mine = queries.select(F.col("id").alias("vec_id"), F.col("key").alias("q")).join(pool, "q").where(~((F.col("distance") == 0) & F.col("vec_id").eqNullSafe(F.col("neighbor_id"))))
    last = W.partitionBy("vec_id", "q").orderBy("distance", F.col("neighbor_id").asc_nulls_last())
    return mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")


def _one_length(distinct: DataFrame, n: int, asking: DataFrame, k: int, pivots: int, prefix: int, depth: float, tile: int) -> DataFrame:
    """(q, key, distance): the best ``k`` of each shard."""
    spark = distinct.sparkSession
    centres = _matrix(distinct.orderBy(F.xxhash64("key"), "key").select("vec").limit(pivots).toArrow().column("vec"))  # its size is the parameter
    held = spark.sparkContext.broadcast(centres)
    shards = math.ceil(n / tile)
    mean = depth * math.sqrt(n) / shards
    share = max(k + 1, math.ceil(mean + (6 * math.sqrt(mean) + 16) * (shards > 1)))
    asked = distinct.join(asking, "key", "left_semi").select("key", "vec")
    blocks = max(1, math.ceil(asked.count() / tile))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    spread = lambda m, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(m)).cast("int")
    posted = distinct.select("key", "id", "vec", F.lit(False).alias("query"), spread(shards, 1).alias("shard"), numbers(blocks).alias("block"))
    asked = asked.select("key", F.lit(None).cast("bigint").alias("id"), "vec", F.lit(True).alias("query"), numbers(shards).alias("shard"), spread(blocks, 2).alias("block"))
    return posted.unionByName(asked).groupBy("shard", "block").applyInArrow(_search(held, prefix, share, k), "q bigint, key bigint, distance double")
