"""Operator 3: near duplicates by a chosen-path set similarity join over MinHash signatures.

A document is the set of its shingles of three words (lower case, letters and
digits). Its signature holds, for each of 256 bins of the shingles' hashes, the
least hash in it. Documents with equal words collapse to one, which goes down
``trees`` independent trees for all: a node chooses 1/threshold coordinates of
the signature by a hash of its path, and a document goes to the child named by
the minwise token it has there, so a pair as similar as the threshold is expected
to meet in one child at least. Only nodes of more than ``leaf`` documents branch
on; a dense one (a quarter of its pairs share the token of a further coordinate)
and one at the greatest depth don't, as branching wouldn't part them.

Nodes that don't branch are compared exhaustively, in tiles of at most ``tile``
documents a side, each a task's work. A pair that meets in several nodes counts in
the first of them alone. Its resemblance is estimated from the signatures; within
four standard deviations of the threshold it is computed from the two sets of
shingles, so links are exact but for once in some 10**4 pairs. No pair is written:
a task returns each document's number of links and a spanning forest. Classes are
the connected components of the links.

Defined results:

* Null, empty and word-free texts are no one's near duplicates. Characters of scripts without blanks are words.
* The document of a class with the least id stays (null ids last, then by content); its id is the class's, null if all ids are null.
* Documents with equal words have the links of each, which don't count copies; a class of copies alone has 0 links.
* Rows with equal id and text are one document; all but one of them are copies. Of their other columns those of the least hash stay.
* A very long text is one set like any other. Empty table: empty result. Other columns, whatever their names, aren't read, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import BROADCAST_BYTES, cut, fits, hide, maybe_broadcast, pick, row_key, unhide
from .wordhash import chunks, mix, relax, span_hashes, string_bytes, word_spans

BINS = 256
#: Coordinates that nodes below the first choose from, as tokens of 32 bits.
TOKENS = 64
SHINGLE = 3
THRESHOLD = 0.5
TREES = 6
LEAF = 200
DEPTH = 8
TILE = 1024
DENSE = 0.25
#: Signature bytes, or incidences, that are compared at once.
AT_ONCE = 1 << 23
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of each word, words of each row, place and hash of each word, shingles, row of each shingle)."""
    row, starts, ends = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = (np.arange(len(row)) - first[row]).astype(np.uint64)
    parts = h * _C[0]
    parts[:-1] += h[1:] * _C[1] * (row[1:] == row[:-1])
    parts[:-2] += h[2:] * _C[2] * (row[2:] == row[:-2])
    # a text of fewer words than a shingle is one shingle
    whole = np.flatnonzero((count[row] - at.astype(np.int64) >= SHINGLE) | (at == 0))
    return row, count, at, h, mix(parts[whole]), row[whole]


def _donors(tries: int) -> np.ndarray:
    """For each try, the bin that an empty bin looks at."""
    x = np.arange(tries * BINS, dtype=np.uint64).reshape(tries, BINS) * _C[1] + _C[0]
    return (mix(x) % np.uint64(BINS)).astype(np.int64)


_DONORS = _donors(48)


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words, content hashes, bins with a hash of their own, signature) of each text given as bytes; the signature of a text without words is empty bins."""
    n = len(offsets) - 1
    row, count, at, h, shingle, of = _shingles(data, offsets)
    content = np.zeros((2, n), np.uint64)
    np.add.at(content[0], row, mix(h ^ (at * _C[1])))
    np.add.at(content[1], row, mix((h * _C[2]) ^ (at * _C[0] + _C[1])))
    sig = np.full(n * BINS, _NONE, np.uint64)
    np.minimum.at(sig, of * BINS + (shingle >> np.uint64(56)).astype(np.int64), shingle & np.uint64((1 << 56) - 1))
    sig = sig.reshape(n, BINS)
    bare = sig.copy()
    filled = (sig != _NONE).sum(1)
    r, c = np.nonzero((sig == _NONE) & (count > 0)[:, None])
    for donors in _DONORS:
        if not len(r):
            break
        v = bare[r, donors[c]]
        sig[r, c] = v
        empty = v == _NONE
        r, c = r[empty], c[empty]
    step = 1
    while len(r):
        v = bare[r, (c + step) % BINS]
        sig[r, c] = v
        empty = v == _NONE
        r, c, step = r[empty], c[empty], step + 1
    return count, content, filled, sig


def branches(threshold: float) -> int:
    return max(1, round(1 / threshold))


def chosen(node: np.ndarray, i: int, of: int = BINS) -> np.ndarray:
    """The i-th coordinate that each node chooses."""
    return (mix(node * _C[1] + np.uint64(i + 1) * _C[2]) % np.uint64(of)).astype(np.int64)


def roots(sig: np.ndarray, trees: int, threshold: float) -> np.ndarray:
    """The nodes below the trees' roots to which each signature goes."""
    out = []
    for t in range(trees):
        root = mix(np.array([t + 1], np.uint64) * _C[0])
        for i in range(branches(threshold)):
            k = chosen(root, i)[0]
            out.append(mix(sig[:, k] * _C[1] + root[0] + np.uint64(i)))
    return np.stack(out, 1)


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _fixed(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    raw, offs = string_bytes(column)
    return np.ascontiguousarray(raw).view(kind).reshape(len(offs) - 1, width)


def _sign(trees: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_bytes(b.column("text"))
            for lo, hi in chunks(offsets):
                count, content, filled, sig = signatures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep = np.flatnonzero(count)
                sig = sig[keep]
                nodes = roots(sig, trees, threshold)
                take = pa.array(keep + lo)
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).take(take) for c in ("id", "rk", "th")), *(pa.array(c[keep].view(np.int64)) for c in content), pa.array(filled[keep].astype(np.int16)),
                    _bytes((sig & np.uint64(255)).astype(np.uint8)), _bytes(sig[:, :: BINS // TOKENS].astype(np.uint32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * nodes.shape[1]), pa.array(nodes.view(np.int64).ravel())),
                ], ["id", "rk", "th", "c1", "c2", "bins", "sig", "tok", "nodes"])
        relax()

    return run


def _branch(threshold: float):
    """The children of each row's node to which the row goes, and its token at a further coordinate."""
    many = branches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy().view(np.uint64)
            tok = _fixed(b.column("tok"), np.uint32, TOKENS)
            at = lambda i: np.take_along_axis(tok, chosen(node, i, TOKENS)[:, None], 1)[:, 0].astype(np.uint64)
            child = np.stack([mix(at(i) * _C[1] + node + np.uint64(i + 1)) for i in range(many)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * many), pa.array(child.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "key", "n", "rank")), pa.array(at(many).astype(np.int64)), lists], ["node", "key", "n", "rank", "probe", "children"])

    return run


def leaves(reps: DataFrame, signed: DataFrame, threshold: float, leaf: int, depth: int) -> DataFrame:
    """(key, rank, node, n): the nodes that are compared, with their documents and their number; ``rank`` puts the trees' first nodes first."""
    spread = reps.select("key", F.posexplode("nodes").alias("rank", "node"))
    out, level = None, 0
    while True:
        sizes = spread.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = cut(spread.join(sizes, "node").select("node", "key", "n", "rank"))
        big = rows.where(F.col("n") > leaf)
        small = rows.where(F.col("n") <= leaf)
        out = small if out is None else out.unionByName(small)
        if big.isEmpty():
            return out
        level += 1
        wide = cut(big.join(signed.select("key", "tok"), "key").mapInArrow(_branch(threshold), "node bigint, key bigint, n bigint, rank int, probe bigint, children array<bigint>"))
        share = wide.groupBy("node", "n", "probe").agg(F.count("*").alias("c")).groupBy("node", "n").agg((F.sum(F.col("c") * F.col("c")) / F.max(F.col("n") * F.col("n"))).alias("share"))
        judged = cut(wide.join(share.select("node", (F.col("share") >= (DENSE if level < depth else 0.0)).alias("dense")), "node"))
        out = out.unionByName(judged.where("dense").select("node", "key", "n", "rank"))
        spread = judged.where("not dense").select("key", F.lit(100 + level).alias("rank"), F.explode("children").alias("node"))


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches, cut so that no group of equal values is split, and where groups begin."""

    def changes(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for n in names:
            v = t.column(n).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
            if len(held) > 1 and all(held[0].column(n)[0] == b.column(n)[b.num_rows - 1] for n in names):
                continue
            t = pa.Table.from_batches(held)
            starts = changes(t)
            if len(starts) > 1:
                yield t.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
                held = t.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, changes(t)


def estimate(same: np.ndarray) -> np.ndarray:
    """Resemblance from the number of equal lanes; lanes of a byte agree by chance once in 256."""
    return (same / BINS - 1 / 256) / (1 - 1 / 256)


def margin(bins: np.ndarray) -> np.ndarray:
    """Four standard deviations of an estimate from so many bins, at most."""
    return 2 / np.sqrt(np.maximum(bins, 1))


def candidates(sig: np.ndarray, starts: np.ndarray, size: np.ndarray, bins: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, estimate) of the pairs within groups that may reach the threshold, some at a time."""

    def rated(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = estimate((sig[i] == sig[j]).sum(1))
        ok = e >= np.maximum(0.02, threshold - margin(np.minimum(bins[i], bins[j])))
        return i[ok], j[ok], e[ok]

    for m in np.unique(size[size <= 32]):
        own, (i, j) = starts[size == m], np.triu_indices(m, 1)
        step = max(1, AT_ONCE // (BINS * max(1, len(i))))
        for lo in range(0, len(own) if len(i) else 0, step):
            at = own[lo : lo + step, None]
            yield rated((at + i).ravel(), (at + j).ravel())
    for s, m in zip(starts[size > 32], size[size > 32]):
        step = max(1, AT_ONCE // (BINS * m))
        for lo in range(0, m, step):
            i, j = np.nonzero(np.arange(lo, min(m, lo + step))[:, None] < np.arange(m))
            if len(i):
                yield rated(s + lo + i, s + j)


def first_met(codes: np.ndarray, bounds: np.ndarray, me: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share no node before the one they are compared in; a row's nodes are ascending codes."""
    many = np.diff(bounds)
    width = int(max(many[i].max(initial=0), many[j].max(initial=0)))
    new = np.ones(len(i), bool)
    step = max(1, AT_ONCE // max(1, 8 * width))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        at = np.arange(width)
        theirs = np.where(at < many[b][:, None], codes[np.minimum(bounds[b][:, None] + at, len(codes) - 1)], -1)
        for u in range(width):
            c = codes[np.minimum(bounds[a] + u, len(codes) - 1)]
            ask = np.flatnonzero((u < many[a]) & (c < me[a]) & new[lo : lo + step])
            if not len(ask):
                break
            new[lo + ask[(theirs[ask] == c[ask, None]).any(1)]] = False
    return new


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def overlaps(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many values each two of the rows share; a row's values are distinct."""
    many = np.diff(bounds)[rows]
    flat = np.concatenate([values[bounds[r] : bounds[r + 1]] for r in rows])
    of = np.repeat(np.arange(len(rows)), many)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[name] > 1
    name, of = name[keep], of[keep]
    if not len(name):
        return np.zeros((len(rows), len(rows)))
    _, name = np.unique(name, return_inverse=True)
    order = np.argsort(name, kind="stable")
    name, of = name[order], of[order]
    out = np.zeros((len(rows), len(rows)))
    step = max(1, AT_ONCE // (4 * len(rows)))
    for lo in range(0, int(name[-1]) + 1, step):
        a, z = np.searchsorted(name, [lo, lo + step])
        held = np.zeros((len(rows), min(step, int(name[-1]) + 1 - lo)), np.float32)
        held[of[a:z], name[a:z] - lo] = 1
        out += held @ held.T
    return out


FOUND = "key bigint, links int, other bigint, node bigint, a int, b int, side int, code bigint, bins smallint, sig binary, codes array<bigint>"
_CELL = ("node", "a", "b")


def _compare(threshold: float, exact: bool):
    """Links and forest of the sure pairs, and the rows of unsure ones; or, with their sets, of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for t, starts in _runs(batches, _CELL):
            key, me, side, bins = (t.column(c).combine_chunks().to_numpy() for c in ("key", "code", "side", "bins"))
            mixed = t.column("a").combine_chunks().to_numpy() != t.column("b").combine_chunks().to_numpy()
            sig = _fixed(t.column("sig"), np.uint8, BINS)
            lists = t.column("codes").combine_chunks()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            codes = lists.values.to_numpy()
            size = np.diff(np.concatenate([starts, [len(key)]]))
            unsure, one, two = np.zeros(len(key), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if exact:
                sets = t.column("shingles").combine_chunks()
                at, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
                group = np.repeat(np.arange(len(starts)), size)
            for i, j, e in candidates(sig, starts, size, bins, threshold):
                ok = ~mixed[i] | (side[i] != side[j])
                i, j, e = i[ok], j[ok], e[ok]
                ok = first_met(codes, bounds, me, i, j)
                i, j, e = i[ok], j[ok], e[ok]
                sure = e >= threshold + margin(np.minimum(bins[i], bins[j]))
                if not exact:
                    unsure[i[~sure]] = unsure[j[~sure]] = True
                    i, j = i[sure], j[sure]
                else:
                    i, j = i[~sure], j[~sure]
                    good = np.zeros(len(i), bool)
                    for g in np.unique(group[i]):
                        here = np.flatnonzero(group[i] == g)
                        rows, back = np.unique(np.concatenate([i[here], j[here]]), return_inverse=True)
                        a, b = back[: len(here)], back[len(here) :]
                        both = overlaps(values, at, rows)[a, b]
                        many = np.diff(at)[rows]
                        good[here] = both >= threshold * (many[a] + many[b] - both) - 1e-9
                    i, j = i[good], j[good]
                one.append(i)
                two.append(j)
            i, j = np.concatenate(one), np.concatenate(two)
            links = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
            root = forest(len(key), i, j)
            some = np.flatnonzero(links)
            if len(some):
                flat = [pa.array(key[some]), pa.array(links[some].astype(np.int32)), pa.array(key[root[some]])]
                yield pa.RecordBatch.from_arrays([*flat, *(pa.nulls(len(some), kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int16(), pa.binary(), pa.list_(pa.int64())))], names)
            if unsure.any():
                rest = t.filter(pa.array(unsure)).combine_chunks()
                n = rest.num_rows
                columns = [rest.column("key"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), *(rest.column(c) for c in names[3:])]
                yield from pa.table(columns, names).cast(pa.schema([("key", pa.int64()), ("links", pa.int32()), ("other", pa.int64()), ("node", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("side", pa.int32()), ("code", pa.int64()), ("bins", pa.int16()), ("sig", pa.binary()), ("codes", pa.list_(pa.int64()))])).to_batches()
        relax()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, as hashes of 32 bits."""
    for b in batches:
        data, offsets = string_bytes(b.column("text"))
        for lo, hi in chunks(offsets):
            *_, shingle, of = _shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            both = np.unique((of.astype(np.uint64) << np.uint64(32)) | (shingle >> np.uint64(32)))
            bounds = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
            values = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))], ["key", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b): alternating large and small stars until nothing changes."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        n = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if n == mark or not n[0]:
            return now.select(F.col("u").alias("key"), F.col("v").alias("root"))
        mark = n
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def _marked(docs: DataFrame) -> DataFrame:
    """(id, rk, th, text): two hashes tell documents, and so ids with texts, apart."""
    slim = pick(docs, id="doc_id:bigint", text="text").where("text is not null")
    return slim.select("id", row_key(F.col("id"), F.col("text")).alias("rk"), _text_hash(F.col("text")).alias("th"), F.lower("text").alias("text"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, tile: int = TILE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, rk, th, class_id, kept, links) of every row that has a copy or a link."""
    signed = _marked(docs).mapInArrow(_sign(trees, threshold), "id bigint, rk bigint, th bigint, c1 bigint, c2 bigint, bins smallint, sig binary, tok binary, nodes array<bigint>")
    signed = cut(signed.withColumn("key", F.monotonically_increasing_id()))
    place = F.struct(F.isnull("id").alias("late"), "id", "th", "rk", "key")
    same = signed.groupBy("c1", "c2").agg(F.min(place).alias("rep"), F.count("*").alias("n")).where("n > 1").select("c1", "c2", F.col("rep.key").alias("rep"))
    twins = cut(signed.select("key", "c1", "c2").join(same, ["c1", "c2"]).select("key", "rep"))
    spare = twins.where("key <> rep").select("key")
    reps = signed.join(maybe_broadcast(spare, spare.count(), 16, broadcast_bytes), "key", "left_anti")
    found = leaves(reps, signed, threshold, leaf, depth)
    code = F.shiftleft(F.col("rank").cast("bigint"), 56) + F.shiftrightunsigned("node", 8)
    found = cut(found.select("key", "node", code.alias("code"), F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    # a document's nodes: two a tree, and those below large ones
    own = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("code", "node", "tiles"))).alias("at"))
    wide = own.join(signed.select("key", "bins", "sig"), "key").select("key", "bins", "sig", F.col("at.code").alias("codes"), F.explode("at").alias("x")).select("key", "bins", "sig", "codes", "x.*")
    mine = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    wide = wide.withColumn("mine", mine).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    wide = wide.select("key", "bins", "sig", "codes", "node", "code", F.least("mine", "c").alias("a"), F.greatest("mine", "c").alias("b"), F.when(F.col("mine") <= F.col("c"), 0).otherwise(1).alias("side"))
    sorted_ = lambda df: df.repartition(*_CELL).sortWithinPartitions(*_CELL, "key")
    first = cut(sorted_(wide).mapInArrow(_compare(threshold, False), FOUND))
    result = first.where("node is null").select("key", "links", "other")
    open_ = first.where("node is not null").drop("links", "other")
    asked = cut(open_.select("key").distinct().join(signed.select("key", "rk", "th"), "key"))
    # texts stay where they are as long as the keys of those asked for can be sent
    texts = _marked(docs).join(maybe_broadcast(asked, asked.count(), 48, broadcast_bytes), ["rk", "th"]).select("key", "text")
    # equal rows have equal sets
    sets = texts.mapInArrow(_sets, "key bigint, shingles array<int>").dropDuplicates(["key"])
    second = sorted_(open_.join(sets, "key")).mapInArrow(_compare(threshold, True), FOUND)
    result = cut(result.unionByName(second.select("key", "links", "other")))
    links = result.groupBy("key").agg(F.sum("links").cast("int").alias("links")).withColumnRenamed("key", "rep")
    parts = components(result.select(F.col("key").alias("a"), F.col("other").alias("b")))
    joined = parts.union(parts.select(F.col("root").alias("key"), "root").distinct()).select(F.col("key").alias("rep"), "root")
    rows = twins.unionByName(joined.join(twins.select("rep"), "rep", "left_anti").select(F.col("rep").alias("key"), "rep"))
    rows = rows.join(joined, "rep", "left").join(links, "rep", "left").select("key", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    members = cut(rows.join(signed.select("key", "id", "rk", "th"), "key"))
    best = members.groupBy("root").agg(F.min(place).alias("best"))
    return members.join(best, "root").select("id", "rk", "th", F.col("best.id").alias("class_id"), (F.col("key") == F.col("best.key")).alias("kept"), "links")


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links) of every row that has a copy or a link: the class's least id, and how many different texts are linked to this one."""
    return near_groups(docs, **options).select(F.col("id").alias("doc_id"), "class_id", "links")


def drop_near(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The documents with all their columns, one row of each class."""
    judged = cut(near_groups(docs, broadcast_bytes=broadcast_bytes, **options).groupBy("rk", "th").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").select(F.col("rk").alias("_rk"), F.col("th").alias("_th"), "kept"))
    gone, once = judged.where("not kept").drop("kept"), judged.where("kept").drop("kept")
    rows, again = judged.agg(F.count("*"), F.count_if("kept")).first()
    if fits(rows, 32, broadcast_bytes):
        gone, once = F.broadcast(gone), F.broadcast(once)
    work, where = hide(docs)
    text = F.col(where["text"]).cast("string")
    left = work.withColumn("_rk", row_key(F.col(where["doc_id"]).cast("bigint"), text)).withColumn("_th", _text_hash(text)).join(gone, ["_rk", "_th"], "left_anti")
    if again:
        plain = [f for f in work.schema if not isinstance(f.dataType, T.MapType)]
        one = left.join(once, ["_rk", "_th"], "left_semi").groupBy("_rk", "_th").agg(F.min_by(F.struct(*work.columns), F.xxhash64(*[f.name for f in plain])).alias("one"))
        left = left.join(once, ["_rk", "_th"], "left_anti").select(*work.columns).unionByName(one.select("one.*"))
    return unhide(left, docs.columns)
