"""Dictionaries: all-substring matches, exact look-up and the boundary features of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize
from .ngrams import BROADCAST_BYTES, _chunks

MAX_DICTIONARIES = 8
LENGTH_CAP = 4


def dictionary(words: list[DataFrame]) -> DataFrame:
    """(word, in_dict) of up to 8 frames of one column: normalised words and the mask of the dictionaries that hold them."""
    if not 0 < len(words) <= MAX_DICTIONARIES:
        raise ValueError(f"1 to {MAX_DICTIONARIES} dictionaries are possible")
    tagged = [df.select(normalize(df[df.columns[0]]).alias("word"), F.lit(1 << i).alias("bit")) for i, df in enumerate(words)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.where("word <> ''").groupBy("word").agg(F.bit_or("bit").alias("in_dict"))


def automaton(words: dict[str, int], whole: bool = True):
    """Finds (end, (word, mask)) of each word; without ``whole`` (end, mask)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w, mask in words.items():
        out.add_word(w, (w, mask) if whole else mask)
    if words:
        out.make_automaton()
    return out


def _collected(entries: DataFrame, limit: int) -> dict[str, int] | None:
    """The entries, if they are few enough to be sent to every executor."""
    n = entries.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    return dict(entries.select("word", "in_dict").toArrow().to_pandas().itertuples(index=False)) if n <= limit else None


def _substrings(lines: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    """Matches by equi-join of the substrings that are as long as some entry."""
    # a row a length: their number, not the longest, bounds the rows of a character
    sizes = sorted(r[0] for r in entries.select(F.length("word")).distinct().collect())
    at = F.explode(F.sequence(F.lit(1), F.length(column)))
    n = F.explode(F.filter(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda x: x <= F.length(column) - F.col("at") + 1))
    parts = lines.where(F.length(column) > 0).withColumn("at", at).withColumn("n", n)
    parts = parts.withColumn("word", F.substr(column, F.col("at"), F.col("n")))
    return parts.join(entries, "word").withColumn("end", F.col("at") + F.col("n") - 2).drop("at", "n")


def match_counts(lines: DataFrame, entries: DataFrame, column: str = "norm", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, in_dict, n): occurrences of each entry as a substring."""
    held = _collected(entries, broadcast_bytes)
    if held is None:
        return _substrings(lines.select(column), entries, column).groupBy("word", "in_dict").agg(F.count("*").alias("n"))
    sent = lines.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = automaton(sent.value), dict.fromkeys(sent.value, 0)
        for b in batches if total else ():
            for text in b.column(0).to_pylist():
                for _, (w, _) in find.iter(text):
                    total[w] += 1
        found = [(w, sent.value[w], n) for w, n in total.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64())], ["word", "in_dict", "n"])

    return lines.where(F.isnotnull(column)).select(column).mapInArrow(run, "word string, in_dict int, n bigint").groupBy("word", "in_dict").agg(F.sum("n").alias("n"))


def matches(lines: DataFrame, entries: DataFrame, column: str = "norm", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The lines, a row for each match: ``end`` (of its last character), ``word``, ``in_dict``."""
    held = _collected(entries, broadcast_bytes)
    if held is None:
        return _substrings(lines, entries, column)
    sent, names = lines.sparkSession.sparkContext.broadcast(held), lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(sent.value)
        for b in batches if sent.value else ():
            # by end, the longest first
            found = [(i, e, w, m) for i, t in enumerate(b.column(column).to_pylist()) if t for e, w, m in sorted(((e, w, m) for e, (w, m) in find.iter(t)), key=lambda x: (x[0], -len(x[1])))]
            take = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in names], *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32())))], [*names, "end", "word", "in_dict"])

    return lines.mapInArrow(run, T.StructType([*lines.schema, *(T.StructField(n, t) for n, t in (("end", T.IntegerType()), ("word", T.StringType()), ("in_dict", T.IntegerType())))]))


def boundary_features(found: list[tuple[int, int, int]], length: int, cap: int = LENGTH_CAP) -> set[tuple[int, str]]:
    """(boundary, feature) of matches (end, size, mask) in a text; each feature once a boundary.

    L: the word lies left of the boundary; R: right of it; I: across it.
    """
    out: set[tuple[int, str]] = set()
    for end, size, mask in found:
        n = min(size, cap)
        for d in range(MAX_DICTIONARIES):
            if mask >> d & 1:
                start = end - size + 1
                if start > 0:
                    out.add((start - 1, f"D{d}R{n}"))
                if end < length - 1:
                    out.add((end, f"D{d}L{n}"))
                out.update((b, f"D{d}I{n}") for b in range(start, end))
    return out


def boundary_feature_counts(lines: DataFrame, entries: DataFrame, cap: int = LENGTH_CAP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(name, n): at how many boundaries each dictionary feature holds."""
    held = _collected(entries, broadcast_bytes)
    if held is None:
        rows = _substrings(lines.select(F.monotonically_increasing_id().alias("row"), "norm"), entries, "norm")
        size, bits = F.length("word"), F.expr(f"filter(sequence(0, {MAX_DICTIONARIES - 1}), d -> (in_dict & shiftleft(1, d)) > 0)")
        first = F.col("end") - size + 1
        inner = F.when(size > 1, F.transform(F.sequence(first, F.col("end") - 1), lambda b: F.struct(b.alias("b"), F.lit("I").alias("p")))).otherwise(F.array())
        sides = F.concat(inner, F.array(F.struct((first - 1).alias("b"), F.lit("R").alias("p")), F.struct(F.col("end").alias("b"), F.lit("L").alias("p"))))
        rows = rows.withColumn("d", F.explode(bits)).withColumn("s", F.explode(sides)).where((F.col("s.b") >= 0) & (F.col("s.b") < F.length("norm") - 1))
        name = F.concat(F.lit("D"), "d", "s.p", F.least(size, F.lit(cap)))
        return rows.select("row", F.col("s.b").alias("b"), name.alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"))
    sent = lines.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton({w: len(w) << MAX_DICTIONARIES | mask for w, mask in sent.value.items()}, whole=False)
        total: dict[str, int] = {}
        for b in batches if sent.value else ():
            for _, texts in _chunks(iter([b]), "norm"):
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
                inner = np.ones(bounds[-1] + 1, bool)  # is there a boundary after the character?
                inner[bounds[1:] - 1] = False
                found = [np.fromiter((x for hit in find.iter(t) for x in hit), np.int64).reshape(-1, 2) + (int(lo), 0) for t, lo in zip(texts, bounds)]
                end, value = np.concatenate(found).T if found else np.zeros((2, 0), np.int64)
                size, mask = value >> MAX_DICTIONARIES, value & ((1 << MAX_DICTIONARIES) - 1)
                for d in range(MAX_DICTIONARIES):
                    for n in range(1, cap + 1):
                        some = ((mask >> d) & 1 == 1) & (np.minimum(size, cap) == n)
                        if some.any():
                            e, first = end[some], end[some] - size[some] + 1
                            across = np.cumsum(np.bincount(first, minlength=len(inner)) - np.bincount(e, minlength=len(inner))) > 0
                            left, right = np.zeros(len(inner), bool), np.zeros(len(inner), bool)
                            left[e] = True
                            right[first[first > 0] - 1] = True
                            for p, at in (("L", left), ("I", across), ("R", right)):
                                if m := int((at & inner).sum()):
                                    total[f"D{d}{p}{n}"] = total.get(f"D{d}{p}{n}", 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["name", "n"])

    return lines.where(F.length("norm") > 0).select("norm").mapInArrow(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))


def unknown_words(words: DataFrame, entries: DataFrame, column: str = "word") -> DataFrame:
    """The words whose normal form no dictionary holds."""
    return words.withColumn("_norm", normalize(F.col(column))).join(entries.select(F.col("word").alias("_norm")), "_norm", "left_anti").drop("_norm")


def flag_unknown(words: DataFrame, entries: DataFrame, column: str = "word") -> DataFrame:
    """All words, with ``unknown``."""
    marked = entries.select(F.col("word").alias("_norm"), F.lit(False).alias("unknown"))
    both = words.withColumn("_norm", normalize(F.col(column))).join(marked, "_norm", "left").drop("_norm")
    return both.withColumn("unknown", F.coalesce("unknown", F.lit(True)))


def dictionary_mask(mask: Column, number: int) -> Column:
    return F.shiftright(mask, number).bitwiseAND(F.lit(1)) == 1
