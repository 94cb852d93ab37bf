"""Operator 2: sum-of-squares online packing.

Documents come one after another (by doc_id within a shard) and are put into
windows of ``capacity`` tokens. A level array holds how many partially filled
windows there are of each fill; a document goes to the level, or to a new
window, that leaves the least sum of squared counts (ties: the fullest level).
A document longer than a window fills whole windows first and its rest is
placed like any other piece. Tokens are those that operator 4's encoder makes
without dropout, which are the public library's; ``unit="words"`` counts runs of
characters other than white space instead.

Shards pack independently. A shard is a range of hashes of id and text, and their
number follows from the corpus' tokens, so a shard's work is the same at any size.

Defined results:

* Null or empty text, or text without words where words are counted, has no tokens and no row. Null ids are packed, last in their shard, and spread by their texts.
* A very long text is encoded whole. Other columns, whatever their names, aren't read.
* Repeated rows are packed each; among rows with equal ids the shorter comes first.
* Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, pick
from .pieces import MODEL, TOGETHER, encode, sent, tables
from .wordhash import chunks, relax, string_bytes

CAPACITY = 2048
WINDOWS_A_SHARD = 2048
SCHEMA = "doc_id bigint, piece int, start bigint, tokens int, shard int, window int, offset int"


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, tokens, window, offset) of every piece, in order of arrival."""
    counts = np.zeros(capacity + 1, np.int64)  # of partially filled windows, by fill
    open_: list[list[int]] = [[] for _ in range(capacity)]
    used, out = 0, []
    for item, size in enumerate(sizes):
        start = 0
        while size - start >= capacity:
            out.append((item, start, capacity, used, 0))
            used += 1
            start += capacity
        s = size - start
        if not s:
            continue
        levels = np.flatnonzero(counts[1 : capacity - s + 1]) + 1
        best, cost = 0, 2 * int(counts[s]) + 1
        if len(levels):
            after = levels + s
            change = 2 * (np.where(after < capacity, counts[after] + 1, 0) - counts[levels]) + np.where(after < capacity, 0, 1)
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = int(levels[k])
        if best:
            window = open_[best].pop()
            counts[best] -= 1
        else:
            window, used = used, used + 1
        out.append((item, start, s, window, best))
        if best + s < capacity:
            counts[best + s] += 1
            open_[best + s].append(window)
    return out


def _pack_shard(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("late", "ascending"), ("doc_id", "ascending"), ("n", "ascending")])
        placed = pack(table.column("n").to_pylist(), capacity)
        item, start, tokens, window, offset = (np.array(x, np.int64) for x in (zip(*placed) if placed else [[]] * 5))
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(item)), "piece": pa.array((start // capacity).astype(np.int32)), "start": pa.array(start),
            "tokens": pa.array(tokens.astype(np.int32)), "shard": pa.array(np.full(len(item), key[0].as_py(), np.int32)),
            "window": pa.array(window.astype(np.int32)), "offset": pa.array(offset.astype(np.int32)),
        })

    return run


def _count_tokens(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables(held.value)
        for b in batches:
            data, offsets = string_bytes(b.column("text"))
            counts = [np.zeros(0, np.int64)]
            for lo, hi in chunks(offsets, TOGETHER):
                _, bounds = encode(pieces, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.zeros(hi - lo, np.uint64), 0.0)
                counts.append(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(np.concatenate(counts).astype(np.int64))], ["doc_id", "mark", "n"])
        relax()

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, windows_a_shard: int = WINDOWS_A_SHARD, unit: str = "tokens", model: str = MODEL) -> DataFrame:
    """A row for every piece of a document: its window, by shard and number, and where it starts there."""
    if unit not in ("tokens", "words"):
        raise ValueError("unit is tokens or words")
    texts = pick(docs, doc_id="doc_id:bigint", text="text").where("text <> ''").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    if unit == "words":
        sizes = texts.select("doc_id", "mark", F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n"))
    else:
        sizes = texts.mapInArrow(_count_tokens(sent(docs.sparkSession, model)), "doc_id bigint, mark bigint, n bigint")
    sizes = cut(sizes.where("n > 0"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / (capacity * windows_a_shard)))
    spread = sizes.select("doc_id", "n", F.isnull("doc_id").alias("late"), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(shards)).cast("int").alias("shard"))
    return spread.groupBy("shard").applyInArrow(_pack_shard(capacity), SCHEMA)
