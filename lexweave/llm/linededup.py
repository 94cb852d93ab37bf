"""Operator 7: line dedup by winnowing over line hashes.

The lines of a document that aren't blank are normalised and hashed. A window
is the shortest run of lines, from a given line on or back from one, that holds
at least ``min_words`` words. Of each window the line of the least hash (ties:
the first) is selected; a posting is a selected line, once, with its position.
Two places that share a run of ``min_words`` words share a window in it and so
a selected line. Postings are joined on the line's hash, matches are extended
line by line both ways, and a run that reaches ``min_words`` words is deleted
at its later place.

A hash with more than ``hot`` postings isn't joined, as its pairs would grow
with their square: the windows that it was selected from are looked up by their
own hash instead, each against the first place (by doc_id, then content, then
line) that has it. Both ways delete exactly the lines that lie in a run of at
least ``min_words`` words which occurs at an earlier place too, so ``hot`` has
no effect on the result.

Defined results:

* Null text stays null and empty text empty; neither matches anything. Shorter repeated runs, and whole documents of fewer words, stay.
* Rows with equal id and text are one document, and all get its result. Null ids come last.
* A run may repeat within its own document; the later one is deleted, also where both overlap: of a line repeated over and over the first stays.
* A line written without blanks, in characters of three bytes mostly, counts a word a character.
* A document whose lines are all deleted has empty text or blank lines. Empty table: empty result.
* Very long texts are compared whole; a document's lines pass through one task as hashes.
* Other columns are kept as they are, whatever their names; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, cut, fits, hide, pick, row_key
from .quality import normal
from .wordhash import _pow, mix

MIN_WORDS = 50
#: Postings of a line hash up to which its places are compared with each other.
HOT = 8
_BLANK = " \t\n\x0b\f\r"


def _signature(docs: DataFrame) -> DataFrame:
    """(id, key, pos, hs, ws): position, hash and words of each line that isn't blank."""
    slim = pick(docs, id="doc_id:bigint", text="text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), normal(x).alias("s")))

    def words(s: Column) -> Column:
        chars, blanks = F.length(s), F.length(s) - F.length(F.replace(s, F.lit(" ")))
        return F.when((F.octet_length(s) * 5 > chars * 12) & (blanks * 12 < chars), chars - blanks).otherwise(blanks + 1)

    slim = slim.where("text is not null").select(
        "id", row_key(F.col("id"), F.col("text")).alias("key"),
        F.transform(F.filter(lines, lambda x: x["s"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("h"), words(x["s"]).alias("w"))).alias("l"),
    ).where(F.size("l") > 0)
    slim = slim.select("id", "key", F.col("l.i").alias("pos"), F.col("l.h").alias("hs"), F.col("l.w").alias("ws"))
    return slim.dropDuplicates(["key"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(hs: np.ndarray, ws: np.ndarray, offsets: np.ndarray, min_words: int, contents: bool = False) -> tuple[np.ndarray, ...]:
    """(row, start, end, selected[, content hash]) of every window; ends are inclusive, all count from the first line of all rows."""
    n = len(hs)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(ws, out=total[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(n)
    # forth from each line, and back from each line where that isn't the same run
    end = np.searchsorted(total, total[:-1] + min_words, "left") - 1
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ok = end < offsets[1:][row] if n else np.zeros(0, bool)
    okb = (back >= offsets[:-1][row]) & (total[1:] >= min_words) if n else ok
    okb &= ~(ok[np.maximum(back, 0)] & (end[np.maximum(back, 0)] == at)) if n else okb
    start, end = np.concatenate([at[ok], back[okb]]), np.concatenate([end[ok], at[okb]])
    h = hs.astype(np.int64).view(np.uint64)
    least, pick_, content = h[start].copy(), start.copy(), np.zeros(len(start), np.uint64)
    live, i = np.arange(len(start)), start.copy()
    while len(live):
        lower = h[i] < least[live]
        least[live[lower]], pick_[live[lower]] = h[i[lower]], i[lower]
        if contents:
            content[live] = mix(content[live] * np.uint64(31) + h[i])
        more = i < end[live]
        live, i = live[more], i[more] + 1
    return (row[start], start, end, pick_, content.view(np.int64)) if contents else (row[start], start, end, pick_)


def selected(hs: np.ndarray, ws: np.ndarray, offsets: np.ndarray, min_words: int) -> np.ndarray:
    """The selected lines, each once, ascending."""
    return np.unique(windows(hs, ws, offsets, min_words)[3])


def _postings(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, offsets = _lists(b.column("hs"))
            ws, _ = _lists(b.column("ws"))
            at = selected(hs, ws, offsets, min_words)
            row = np.searchsorted(offsets, at, "right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("key").take(take), pa.array(hs[at]), pa.array((at - offsets[row]).astype(np.int32))], ["id", "key", "f", "a"])

    return run


def _hot_windows(min_words: int):
    """The windows of which a hot line was selected, by content, with the numbers of their first and last line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, offsets = _lists(b.column("hs"))
            ws, _ = _lists(b.column("ws"))
            pos, _ = _lists(b.column("pos"))
            hot, bounds = _lists(b.column("hot"))
            row, start, end, at, content = windows(hs, ws, offsets, min_words, contents=True)
            # whether the line is in its own row's list
            order = np.lexsort((hot, np.repeat(np.arange(b.num_rows), np.diff(bounds))))
            both = np.zeros(len(hot), [("row", np.int64), ("h", np.int64)])
            both["row"], both["h"] = np.repeat(np.arange(b.num_rows), np.diff(bounds))[order], hot[order]
            ask = np.zeros(len(at), both.dtype)
            ask["row"], ask["h"] = row, hs[at]
            k = np.searchsorted(both, ask) if len(both) else np.zeros(len(at), np.int64)
            ok = np.flatnonzero((k < len(both)) & (both[np.minimum(k, max(0, len(both) - 1))] == ask)) if len(both) else np.zeros(0, np.int64)
            take = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("key").take(take), pa.array(hs[at[ok]]), pa.array(content[ok]), pa.array(pos[start[ok]].astype(np.int32)), pa.array(pos[end[ok]].astype(np.int32))],
                ["id", "key", "f", "g", "lo", "hi"])

    return run


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of lines follows."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h.astype(np.int64).view(np.uint64).copy()) * _pow(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def extend(mine: np.ndarray, theirs: np.ndarray, words: np.ndarray, a: np.ndarray, sa: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of equal lines through the anchors (a here, sa there) that hold ``min_words`` words; all anchors are extended together."""
    one, two, back = _sums(mine), _sums(theirs), _pow(max(len(mine), len(theirs)) + 1)[1]
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])

    def same(i: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (one[i + n] - one[i]) * back[i] == (two[k + n] - two[k]) * back[k]

    def longest(most: np.ndarray, fits) -> np.ndarray:
        lo, hi = np.zeros(len(most), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = fits(mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    after = longest(np.minimum(len(mine) - a, len(theirs) - sa), lambda n: same(a, sa, n))
    before = longest(np.minimum(a, sa), lambda n: same(a - n, sa - n, n))
    first, last = a - before, a + after - 1
    long = total[last + 1] - total[first] >= min_words
    return first[long], last[long]


def _extend(min_words: int):
    """Per pair of documents: the runs, by line numbers, around the anchors in which the lines are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, m = _lists(b.column("hs"))
            words, _ = _lists(b.column("ws"))
            theirs, t = _lists(b.column("shs"))
            pos, _ = _lists(b.column("pos"))
            here, n = _lists(b.column("a"))
            there, _ = _lists(b.column("sa"))
            row, lo, hi = [], [], []
            for i in range(b.num_rows):
                own = slice(m[i], m[i + 1])
                first, last = extend(mine[own], theirs[t[i] : t[i + 1]], words[own], here[n[i] : n[i + 1]].astype(np.int64), there[n[i] : n[i + 1]].astype(np.int64), min_words)
                runs = np.unique(np.stack([first, last]), axis=1)
                row.append(np.full(runs.shape[1], i))
                lo.append(pos[own][runs[0]])
                hi.append(pos[own][runs[1]])
            if row:
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32))], ["key", "lo", "hi"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a document as few as they go: (key, lo, hi), both lists ascending."""
    for b in batches:
        los, offsets = _lists(b.column("lo"))
        his, _ = _lists(b.column("hi"))
        lo, hi, size = [], [], [0]
        for i in range(b.num_rows):
            order = np.argsort(los[offsets[i] : offsets[i + 1]], kind="stable")
            x, y = los[offsets[i] : offsets[i + 1]][order], np.maximum.accumulate(his[offsets[i] : offsets[i + 1]][order])
            new = np.concatenate([[True], x[1:] > y[:-1] + 1])
            lo.append(x[new])
            hi.append(y[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(y) - 1]])])
            size.append(size[-1] + int(new.sum()))
        ends = pa.array(np.array(size, np.int32))
        flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *v]).astype(np.int32)) for v in (lo, hi)]
        yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.ListArray.from_arrays(ends, v) for v in flat)], ["key", "lo", "hi"])


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(key, lo, hi): the ranges of line numbers in which a document's lines are to be deleted."""
    lines = cut(_signature(docs))
    posts = cut(lines.select("id", "key", "hs", "ws").mapInArrow(_postings(min_words), "id bigint, key bigint, f bigint, a int"))
    counts = cut(posts.groupBy("f").agg(F.count("*").alias("n")).where("n > 1"))
    place = F.struct(F.isnull("id").alias("late"), "id", "key", "a")
    # at most ``hot`` places a hash: each with all before it
    few = posts.join(counts.where(F.col("n") <= hot).select("f"), "f").groupBy("f").agg(F.array_sort(F.collect_list(place)).alias("p"))
    later = few.select(F.posexplode("p").alias("i", "x"), "p").select("x", F.explode(F.slice("p", 1, F.col("i"))).alias("s"))
    pairs = later.groupBy(F.col("x.key").alias("key"), F.col("s.key").alias("skey")).agg(F.collect_list(F.struct(F.col("x.a").alias("a"), F.col("s.a").alias("sa"))).alias("at"))
    pairs = pairs.select("key", "skey", F.col("at.a").alias("a"), F.col("at.sa").alias("sa"))
    own = lines.select("key", "hs", "ws", "pos")
    other = lines.select(F.col("key").alias("skey"), F.col("hs").alias("shs"))
    runs = pairs.join(own, "key").join(other, "skey").mapInArrow(_extend(min_words), "key bigint, lo int, hi int")
    # hot hashes: their windows, each against the first of its content
    many = posts.join(counts.where(F.col("n") > hot).select("f"), "f").groupBy("key").agg(F.collect_set("f").alias("hot"))
    wide = lines.join(many, "key").select("id", "key", "hs", "ws", "pos", "hot").mapInArrow(_hot_windows(min_words), "id bigint, key bigint, f bigint, g bigint, lo int, hi int")
    wide = cut(wide)
    first = wide.groupBy("f", "g").agg(F.min(F.struct(F.isnull("id").alias("late"), "id", "key", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").select("f", "g", F.col("first.key").alias("skey"), F.col("first.lo").alias("slo"))
    again = wide.join(first, ["f", "g"]).where((F.col("key") != F.col("skey")) | (F.col("lo") != F.col("slo"))).select("key", "lo", "hi")
    ranges = runs.unionByName(again).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return ranges.select("key", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")).mapInArrow(_merged, "key bigint, lo array<int>, hi array<int>")


def _without(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    """The texts without the lines, blank ones excepted, in the ranges; null stays null."""
    out = []
    for t, los, his in zip(text, lo, hi):
        if t is None:
            out.append((None, 0))
            continue
        lines, kept, at = t.split("\n"), [], 0
        for a, z in zip(los, his):
            kept += lines[at:a]
            kept += [x for x in lines[a : z + 1] if not x.strip(_BLANK)]
            at = z + 1
        kept += lines[at:]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "removed"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """All documents with all their columns, text without later repeated runs, and ``_removed`` lines."""
    gone = cut(deletions(docs, min_words, hot)).select(F.col("key").alias("_key"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    rows, ranges = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_lo")), F.lit(0))).first()
    if fits(rows * 64 + ranges * 8, 1, broadcast_bytes):
        gone = F.broadcast(gone)
    work, where = hide(docs)
    text = F.col(where["text"]).cast("string")
    both = work.withColumn("_key", row_key(F.col(where["doc_id"]).cast("bigint"), text)).join(gone, "_key", "left")
    both = both.withColumn("_new", F.pandas_udf(_without, "text string, removed int")(F.when(F.isnotnull("_lo"), text), "_lo", "_hi"))
    new = F.when(F.isnull("_lo"), text).otherwise(F.col("_new.text"))
    out = []
    for i, name in enumerate(docs.columns):
        c = F.col(f"_c{i}")
        if f"_c{i}" == where["text"]:
            c = new
        elif name == "n_chars":
            c = F.when(F.isnull("_lo"), c).otherwise(F.length(new)).cast(docs.schema[i].dataType)
        out.append(c.alias(f"_c{i}"))
    return both.select(*out, F.coalesce("_new.removed", F.lit(0)).alias("_removed"))
