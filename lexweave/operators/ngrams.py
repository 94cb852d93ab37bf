"""Position-dependent n-gram evidence for word boundaries, counted and applied by array.

Boundary ``i`` lies between characters ``i`` and ``i + 1``. An n-gram that begins
``o`` characters after ``i`` (``1 - window <= o``, ending no later than
``i + window``) is the feature ``X{o}{gram}``; over type letters it is
``T{o}{gram}``. A compiled table has a row for each n-gram with a weight for
each offset, so that one look-up serves all boundaries the n-gram touches.
Counting is combined within a task before anything is shuffled; no row is made
for a single feature of a single boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_type
from ..sources.arrays import cut, flattened, lists, points, strings, whole

WINDOW = 3
ORDER = 3
#: Characters that are handled at once.
CHUNK = 1 << 21
#: Largest compiled table, in bytes, that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Lines, as a power of two, that share a table of weights where the whole is too large to send.
BLOCK_BITS = 12
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TYPE = np.array([ord(char_type(c)) for c in range(0x30000)], np.uint32)


def offsets(window: int = WINDOW) -> range:
    return range(1 - window, window + 1)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and bounds."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def type_codes(flat: np.ndarray) -> np.ndarray:
    return np.where(flat < len(_TYPE), _TYPE[np.minimum(flat, len(_TYPE) - 1)], np.uint32(ord("O")))


def gram_hashes(flat: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the n-grams; ``room`` is how many characters of its line each character has from itself on."""
    at = np.flatnonzero(room >= n)
    h = np.full(len(at), n, np.uint64) * _C[3]
    for k in range(n):
        h = (h ^ flat[at + k].astype(np.uint64)) * _C[k % 3]
        h ^= h >> np.uint64(29)
    return at, h


def hash_gram(gram: str) -> int:
    flat = np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(gram_hashes(flat, np.arange(len(flat), 0, -1), len(flat))[1][0])


def _layout(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, room) of every character."""
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return line, bounds[1:][line] - np.arange(bounds[-1])


def _touched(at: np.ndarray, o: int, line: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which n-grams, boundaries): those that have a boundary at offset ``o``."""
    b = at - o
    ok = np.flatnonzero((b >= 0) & (b < len(line)))
    ok = ok[(line[b[ok]] == line[at[ok]]) & (room[b[ok]] > 1)]
    return ok, b[ok]


def _chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        lo = used = 0
        for i, t in enumerate(texts):
            used += len(t)
            if used >= size or i == len(texts) - 1:
                yield b.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, used = i + 1, 0


#: Largest table of n-grams that is addressed by their characters.
DIRECT = 1 << 23
_LETTERS = np.array([ord(c) for c in "KTHRDO"], np.uint32)


def _padded(flat: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(where each character lies, how many places there are) with ``window`` places around each line."""
    line = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    return np.arange(len(flat)) + window * line, len(flat) + window * len(bounds)


def _dense(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, which of them each is), 0 being the first of them."""
    if top > 2 * DIRECT:
        found, back = np.unique(np.append(values, 0), return_inverse=True)
        return found, back[:-1]
    seen = np.zeros(top, bool)
    seen[values] = seen[0] = True
    found = np.flatnonzero(seen)
    to = np.zeros(top, np.int64)
    to[found] = np.arange(len(found))
    return found, to[values]


def _text(grams: np.ndarray) -> list[str]:
    n = grams.shape[1]
    whole = grams.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def _tally(window: int, order: int):
    width = 2 * window

    def rows(kind: str, grams: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(grams), pa.string()), pa.array(_text(grams), pa.string()), *map(pa.array, table[1]), *map(pa.array, table[0])]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in tally_schema(window).split(", ")])

    def count(texts: list[str], breaks: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat, bounds = codes(texts)
        if not len(flat):
            return
        at, size = _padded(flat, bounds, window)
        alphabet, back = _dense(flat.astype(np.int64) + 1, 0x110001)
        symbols, ids = alphabet.astype(np.uint32) - np.uint32(1), np.zeros(size, np.int64)
        ids[at] = back
        # of each place: 0 no word ends there, 1 one does, 2 it isn't between two characters
        state = np.full(size, 2, np.int64)
        state[at] = breaks[: len(flat)]
        state[at[bounds[1:][bounds[1:] > bounds[:-1]] - 1]] = 2
        lo, hi = window, size - window
        dense, grams = ids, symbols[:, None]
        for n in range(1, order + 1):
            if n > 1:
                last = np.concatenate([ids[n - 1 :], np.zeros(n - 1, np.int64)])
                top = len(grams) * len(symbols)
                found, dense = _dense(np.where((dense > 0) & (last > 0), dense * len(symbols) + last, 0), top)
                grams = np.concatenate([grams[found // len(symbols)], symbols[found % len(symbols)][:, None]], 1)
            if len(grams) == 1:
                break
            table = np.zeros((2, width, len(grams)), np.int64)
            three = dense[lo:hi] * 3
            for o in range(1 - window, window - n + 2):
                hits = np.bincount(three + state[lo - o : hi - o], minlength=3 * len(grams)).reshape(-1, 3)
                table[0, o + window - 1], table[1, o + window - 1] = hits[:, 0], hits[:, 1]
            own, table = grams[1:], table[:, :, 1:]
            yield rows("X", own, table)
            # the types' n-grams are those of the characters, added up
            kinds = type_codes(own)
            names, which = np.unique(kinds, axis=0, return_inverse=True)
            sums = np.zeros((2, width, len(names)), np.int64)
            for side in range(2):
                for k in range(width):
                    np.add.at(sums[side, k], which.ravel(), table[side, k])
            yield rows("T", names, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _chunks(batches, "norm"):
            # the words of a line are as long as the line: their ends follow from running sums
            breaks = np.zeros(sum(map(len, texts)) + 1, bool)
            breaks[np.cumsum(b.column("lengths").flatten().to_numpy()) - 1] = True
            yield from count(texts, breaks)

    return run


def inner_ends(words: Column) -> Column:
    """The boundaries at which the words end, the last one's excepted."""

    @F.arrow_udf("array<int>")
    def run(lengths: pa.Array) -> pa.Array:
        many = lengths.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(lengths.flatten().to_numpy(), dtype=np.int64)
        last = np.cumsum(many)
        before = np.where(many > 0, np.concatenate([[0], ends])[last - many], 0)
        inner = np.ones(len(ends), bool)
        inner[last[many > 0] - 1] = False
        flat = (ends - np.repeat(before, many) - 1)[inner].astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.maximum(many - 1, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))

    return run(F.transform(words, lambda w: F.length(w)))


def tally_schema(window: int) -> str:
    return "kind string, gram string, " + ", ".join([f"p{k} bigint" for k in range(2 * window)] + [f"n{k} bigint" for k in range(2 * window)])


def count_evidence(lines: DataFrame, window: int = WINDOW, order: int = ORDER) -> DataFrame:
    """(kind, gram, p0.., n0..): how often a word ends, or doesn't, at each offset of each n-gram.

    ``lines`` has ``norm`` and ``words``; column k stands for offset ``k + 1 - window``.
    """
    slim = lines.where(F.length("norm") > 0).select("norm", F.transform("words", lambda w: F.length(w)).alias("lengths"))
    sums = [F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "pn" for k in range(2 * window)]
    return slim.mapInArrow(_tally(window, order), tally_schema(window)).groupBy("kind", "gram").agg(*sums)


def associate(evidence: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kind, gram, w0..): a whole number for how much each offset speaks for a break."""
    weigh = lambda k: F.expr(f"1000 * (p{k} - n{k}) div (p{k} + n{k} + 4)").cast("int").alias(f"w{k}")
    return evidence.select("kind", "gram", *[weigh(k) for k in range(2 * window)])


class Lookup:
    """N-grams' weights by hash."""

    def __init__(self, kinds: list[str], grams: list[str], weights: np.ndarray, bias: int = 0) -> None:
        self.bias, self.width, self._direct = bias, weights.shape[1], None
        self.given = kinds, grams, weights
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        where: dict[tuple[str, int], list[int]] = {}
        for i, (k, g) in enumerate(zip(kinds, grams)):
            where.setdefault((k, len(g)), []).append(i)
        for key, rows in where.items():
            joined = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = key[1]
            h = gram_hashes(joined, np.where(np.arange(len(joined)) % n == 0, n, 0), n)[1]
            order = np.argsort(h)
            self.tables[key] = h[order], weights[np.array(rows)[order]]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_direct": None}

    def _build(self) -> None:
        """Tables addressed by characters, the weights of their types' n-grams added: n to (row of each code, weights)."""
        kinds, grams, weights = self.given
        own = np.unique(codes([g for k, g in zip(kinds, grams) if k == "X"])[0])
        # an id a character that some n-gram has; the others have one a type; 0 lies between lines
        self.size = len(own) + 7
        self.ids = (len(own) + 1 + np.searchsorted(np.sort(_LETTERS), _TYPE)).astype(np.int64)
        self.beyond = len(own) + 1 + int(np.searchsorted(np.sort(_LETTERS), ord("O")))
        self.ids = np.concatenate([self.ids, np.full(0x110000 - len(self.ids), self.beyond)])
        self.ids[own] = np.arange(1, len(own) + 1)
        kind_of = np.concatenate([[0], np.searchsorted(np.sort(_LETTERS), type_codes(own)), np.arange(6)])
        self._direct = {}
        types, valid = np.zeros(1, np.int64), np.ones(1, bool)
        for n in range(1, max([len(g) for g in grams], default=0) + 1):
            if self.size**n > DIRECT:
                break
            types = (types[:, None] * 6 + kind_of).ravel()
            valid = (valid[:, None] & (np.arange(self.size) > 0)).ravel()
            mine = {k: [i for i, g in enumerate(grams) if kinds[i] == k and len(g) == n] for k in "XT"}
            if not (mine["X"] or mine["T"]):
                continue
            by_type = np.zeros((6**n, self.width), np.int64)
            for i in mine["T"]:
                letters = codes([grams[i]])[0]
                if np.isin(letters, _LETTERS).all():
                    by_type[int(sum(int(x) * 6 ** (n - 1 - j) for j, x in enumerate(np.searchsorted(np.sort(_LETTERS), letters))))] += weights[i]
            where = np.where(valid, len(mine["X"]) + types, len(mine["X"]) + 6**n).astype(np.int32)
            table = np.concatenate([weights[mine["X"]].astype(np.int64).reshape(-1, self.width), by_type, np.zeros((1, self.width), np.int64)])
            if mine["X"]:
                at = np.zeros(len(mine["X"]), np.int64)
                for column in self.ids[codes([grams[i] for i in mine["X"]])[0].reshape(-1, n)].T:
                    at = at * self.size + column
                table[: len(at)] += by_type[types[at]]
                where[at] = np.arange(len(at))
            self._direct[n] = where, np.ascontiguousarray(table.T)

    def score(self, flat: np.ndarray, bounds: np.ndarray, line: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The sum at every character's right boundary; meaningless at the end of a line."""
        if self._direct is None:
            self._build()
        window = self.width // 2
        at, size = _padded(flat, bounds, window)
        ids, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids[at] = self.ids[flat]
        code, lo, hi = ids, window, size - window
        for n in range(1, max(self._direct, default=0) + 1):
            if n > 1:
                code = code * self.size + np.concatenate([ids[n - 1 :], np.zeros(n - 1, np.int64)])
            if n in self._direct:
                where, table = self._direct[n]
                row = where[code[lo:hi]]
                for o in range(1 - window, window - n + 2):
                    total[lo - o : hi - o] += table[o + window - 1][row]
        out = total[at] + self.bias
        for kind, seq in (("X", flat), ("T", type_codes(flat))):
            for n in sorted(n for k, n in self.tables if k == kind and n not in self._direct):
                h, w = self.tables[kind, n]
                at, mine = gram_hashes(seq, room, n)
                k = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                known = np.flatnonzero(h[k] == mine)
                at, k = at[known], k[known]
                for o in range(1 - window, window - n + 2):
                    ok, b = _touched(at, o, line, room)
                    out[b] += w[k[ok], o + window - 1]
        return out


def compile_lookup(weights: DataFrame, bias: int = 0) -> Lookup:
    table = weights.toArrow()
    columns = [c for c in table.column_names if c.startswith("w")]
    return Lookup(table.column("kind").to_pylist(), table.column("gram").to_pylist(), np.stack([table.column(c).to_numpy() for c in columns], 1).astype(np.int64), bias)


def break_bias(lines: DataFrame) -> int:
    """The weight that every boundary has: of ends of words against other places."""
    n = lines.agg(F.coalesce(F.sum(F.size("words") - 1), F.lit(0)), F.coalesce(F.sum(F.length("norm") - F.size("words")), F.lit(0))).first()
    return int(1000 * (n[0] - n[1]) / (n[0] + n[1] + 4))


def size_of(weights: DataFrame) -> int:
    """Bytes that a compiled table takes, from a count of its rows."""
    return weights.count() * (8 + 8 * sum(c.startswith("w") for c in weights.columns))


def _scored(lookup: Lookup, b: pa.RecordBatch, texts: list[str], names: list[str], scores: bool | str) -> pa.RecordBatch:
    flat, bounds = codes(texts)
    line, room = _layout(bounds)
    total = lookup.score(flat, bounds, line, room)
    places = np.flatnonzero(room > 1)
    hit = places[total[places] > 0]

    def lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(line[at], np.arange(len(texts) + 1)).astype(np.int32)), pa.array(values))

    more = [] if not scores else [lists(places, total[places])] if scores == "all" else [lists(hit, total[hit])]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists(hit, (hit - bounds[:-1][line[hit]]).astype(np.int32)), *more], [*names, "breaks", *["scores"] * len(more)])


def score_lines(lines: DataFrame, weights: DataFrame, bias: int = 0, broadcast_bytes: int = BROADCAST_BYTES, scores: bool | str = False) -> DataFrame:
    """The lines with ``breaks``: the boundaries that score above 0; on demand also their ``scores``, or those of ``"all"`` boundaries.

    A table that is small enough goes to every task and nothing is shuffled; of a
    larger one each block of lines is sent the n-grams that occur in it. Null
    lines have no boundaries.
    """
    schema = T.StructType([*lines.schema, T.StructField("breaks", T.ArrayType(T.IntegerType())), *([T.StructField("scores", T.ArrayType(T.LongType()))] if scores else [])])
    names = lines.columns
    if size_of(weights) > broadcast_bytes:
        return _score_by_blocks(lines, weights, bias, scores, schema)
    held = lines.sparkSession.sparkContext.broadcast(compile_lookup(weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _chunks(batches, "norm"):
            yield _scored(held.value, b, texts, names, scores)

    return lines.mapInArrow(run, schema)


def _block_grams(order: int):
    """The distinct n-grams of each block of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _chunks(batches, "norm"):
            block = b.column("_block").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for lo, hi in zip(cuts, cuts[1:]):
                flat, bounds = codes(texts[lo:hi])
                _, room = _layout(bounds)
                for kind, seq in (("X", flat), ("T", type_codes(flat))):
                    for n in range(1, order + 1):
                        at, h = gram_hashes(seq, room, n)
                        if len(at):
                            first = at[np.unique(h, return_index=True)[1]]
                            grams = [seq[f : f + n].tobytes().decode("utf-32-le", "surrogatepass") for f in first]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block[lo])), pa.array([kind] * len(grams)), pa.array(grams)], ["_block", "kind", "gram"])

    return run


def _score_by_blocks(lines: DataFrame, weights: DataFrame, bias: int, scores: bool | str, schema: T.StructType) -> DataFrame:
    """The same, over a table of any size: blocks of lines meet the weights of their own n-grams alone."""
    from .storage import keep

    names = lines.columns
    order = weights.agg(F.coalesce(F.max(F.length("gram")), F.lit(1))).first()[0]
    numbered = keep(lines.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    grams = numbered.select("_block", "norm").mapInArrow(_block_grams(order), "_block bigint, kind string, gram string")
    found = grams.join(weights, ["kind", "gram"])
    columns = [c for c in weights.columns if c.startswith("w")]

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        table = np.stack([known.column(c).to_numpy() for c in columns], 1).astype(np.int64)
        lookup = Lookup(known.column("kind").to_pylist(), known.column("gram").to_pylist(), table, bias)
        parts = [_scored(lookup, b, texts, names, scores) for b, texts in _chunks(iter(own.to_batches()), "norm")]
        return pa.Table.from_batches(parts)

    return numbered.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, schema)


def _columns(kernel, kind: str, *columns: Column | str) -> Column:
    """A column by a function of arrays."""
    if len(columns) == 1:

        def run(a: pa.Array) -> pa.Array:
            return kernel(whole(a))
    else:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return kernel(whole(a), whole(b))

    run.__annotations__ = {x: pa.Array for x in (*"ab"[: len(columns)], "return")}
    return F.arrow_udf(run, kind)(*columns)


def _at_breaks(texts: pa.Array, breaks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, bounds, places of the breaks among them)."""
    flat, bounds = points(texts)
    values, many = flattened(breaks)
    return flat, bounds, np.repeat(bounds[:-1], many) + values.to_numpy(zero_copy_only=False)


def constrained(breaks: str, types: str, kinds: str) -> Column:
    """The breaks but those between two characters of the same type, if that is one of ``kinds``."""
    if set(kinds) - set("KTHRDO"):
        raise ValueError("types are among K T H R D O")

    def kernel(b: pa.Array, t: pa.Array) -> pa.Array:
        flat, _, at = _at_breaks(t, b)
        values, many = flattened(b)
        after = np.append(flat, 0)[at + 1]
        keep = ~((flat[at] == after) & np.isin(after, np.array([ord(k) for k in kinds], np.uint32)))
        return lists(cut(keep)[cut(many)], values.filter(pa.array(keep)), b.is_null().to_numpy(zero_copy_only=False))

    return _columns(kernel, "array<int>", breaks, types)


def types_of(text: Column | str) -> Column:
    """One type letter a character."""

    def kernel(t: pa.Array) -> pa.Array:
        flat, bounds = points(t)
        return strings(type_codes(flat), bounds, t.is_null().to_numpy(zero_copy_only=False))

    return _columns(kernel, "string", text)


def types_around(norm: str, breaks: str) -> Column:
    """The types of the two characters around each break."""

    def kernel(t: pa.Array, b: pa.Array) -> pa.Array:
        flat, _, at = _at_breaks(t, b)
        pair = type_codes(np.append(flat, 0)[np.stack([at, at + 1], 1)].ravel().astype(np.uint32))
        return lists(cut(flattened(b)[1]), strings(pair, np.arange(0, len(pair) + 1, 2)))

    return _columns(kernel, "array<string>", norm, breaks)


def total_of(scores: str) -> Column:
    """The sum of whole numbers of each row."""

    def kernel(s: pa.Array) -> pa.Array:
        values, many = flattened(s)
        sums, at = cut(values.to_numpy(zero_copy_only=False)), cut(many)
        return pa.array(sums[at[1:]] - sums[at[:-1]], mask=s.is_null().to_numpy(zero_copy_only=False))

    return _columns(kernel, "bigint", scores)


def merged_breaks(confs: str, scores: str) -> Column:
    """The places at which a word ends: as annotated, or else as scored."""

    def kernel(c: pa.Array, s: pa.Array) -> pa.Array:
        said, many = flattened(c)
        said, scored = said.to_numpy(zero_copy_only=False), s.flatten().to_numpy(zero_copy_only=False)
        at = cut(many)
        hit = np.where(said != 0, said > 0, scored > 0)
        place = np.arange(len(hit)) - np.repeat(at[:-1], many)
        return lists(cut(hit)[at], place[hit].astype(np.int32))

    return _columns(kernel, "array<int>", confs, scores)


def least_of_pairs(scored: DataFrame, row: list[str]) -> DataFrame:
    """(row.., b, conf, pair): of each task's pairs of characters the boundaries nearest to 0, all of those that are as near.

    ``scored`` has norm and the scores of all boundaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, bounds = points(b.column("norm"))
            scores, many = flattened(b.column("scores"))
            scores, at = scores.to_numpy(zero_copy_only=False), cut(many)
            line = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(scores)) - at[:-1][line]
            left = bounds[:-1][line] + place
            symbols, ids = _dense(flat.astype(np.int64) + 1, 0x110001)
            pairs, which = _dense(ids[left] * len(symbols) + ids[left + 1] if len(left) else left, len(symbols) ** 2)
            least = np.full(len(pairs), np.iinfo(np.int64).max)
            np.minimum.at(least, which, np.abs(scores))
            best = np.flatnonzero(np.abs(scores) == least[which])
            two = np.stack([flat[left[best]], flat[left[best] + 1]], 1).ravel() if len(best) else np.zeros(0, np.uint32)
            take = pa.array(line[best])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in row), pa.array(place[best].astype(np.int32)), pa.array(scores[best]), strings(two, np.arange(0, len(two) + 1, 2))], [*row, "b", "conf", "pair"])

    slim = scored.select(*row, "norm", "scores").where(F.size("scores") > 0)
    return slim.mapInArrow(run, T.StructType([*(slim.schema[c] for c in row), *T._parse_datatype_string("b int, conf bigint, pair string")]))


def spans(surface: str = "surface", breaks: str = "breaks") -> Column:
    """The words that the breaks make of the surface."""

    def kernel(t: pa.Array, b: pa.Array) -> pa.Array:
        flat, bounds, at = _at_breaks(t, b)
        some = bounds[1:] > bounds[:-1]
        starts = np.sort(np.concatenate([bounds[:-1][some], at + 1]))
        first = np.append(np.searchsorted(starts, bounds[:-1]), len(starts))
        return lists(first, strings(flat, np.append(starts, len(flat))), b.is_null().to_numpy(zero_copy_only=False))

    return _columns(kernel, "array<string>", surface, breaks)
