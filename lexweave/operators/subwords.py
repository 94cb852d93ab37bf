"""Tags for unknown words: subword alignment, smoothed subword-tag probabilities, a tag model, and search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from . import ngram_lm
from .storage import keep, limited

LONGEST = 256


def align(word: str, tag: str, offers: dict[str, list[str]]) -> list[tuple[str, str]] | None:
    """The first way to write word and tag side by side as subwords and their tags; shorter subwords are tried first."""
    dead: set[tuple[int, int]] = set()
    longest = max(map(len, offers), default=0)

    def ways(i: int, j: int) -> Iterator[tuple[int, int, str]]:
        for e in range(i + 1, min(len(word), i + longest) + 1):
            for t in offers.get(word[i:e], ()):
                if tag.startswith(t, j):
                    yield e, j + len(t), t

    path, open_ = [(0, 0, "")], [ways(0, 0)]
    while open_:
        if path[-1][:2] == (len(word), len(tag)):
            return [(word[a:b], t) for (a, _, _), (b, _, t) in zip(path, path[1:])]
        step = next((x for x in open_[-1] if x[:2] not in dead), None)
        if step is None:
            dead.add(path.pop()[:2])
            open_.pop()
        else:
            path.append(step)
            open_.append(ways(*step[:2]))
    return None


def alignments(pairs: DataFrame, offers: DataFrame) -> DataFrame:
    """(tag, parts): aligned pairs (word, tag) with the subwords and tags they consist of."""
    held: dict[str, list[str]] = {}
    for r in offers.orderBy("word", "seen").toArrow().to_pylist():
        held.setdefault(r["word"], []).append(r["tag"])
    sent = pairs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, align(w, t, sent.value)) for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            found = [(t, [{"subword": a, "tag": c} for a, c in p]) for t, p in found if p]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.struct([("subword", pa.string()), ("tag", pa.string())])))], ["tag", "parts"])

    return pairs.select("word", "tag").mapInArrow(run, "tag string, parts array<struct<subword:string,tag:string>>")


def at_least(counts: list[int]) -> list[int]:
    """How many counts exceed 0, 1, 2 ..."""
    return [sum(c > k for c in counts) for k in range(max(counts, default=0))]


def at_least_histogram(rows: DataFrame, count: str) -> DataFrame:
    """(k, n): for each count k that occurs, how many rows have at least that one."""
    seen = rows.groupBy(F.col(count).alias("k")).agg(F.count("*").alias("m"))
    # a row a distinct count, far fewer than rows
    return seen.select("k", F.sum("m").over(W.orderBy(F.desc("k"))).alias("n"))


def _gamma_slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logarithm of the gamma function."""
    x = np.asarray(x, float).copy()
    one, two = np.zeros_like(x), np.zeros_like(x)
    for _ in range(8):
        one -= 1 / x
        two += 1 / x**2
        x += 1
    r = 1 / x**2
    one += np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
    two += 1 / x + 0.5 * r + (r / x) * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    return one, two


def concentration(parts: dict[int, int], totals: dict[tuple[int, int], int], start: float = 1e-4, stop: float = 1e-7, most: float = 100.0) -> float:
    """The strength of a Dirichlet prior by Newton's method on the likelihood of the counts; 1 if it runs away.

    ``parts``: how many (tag, subword) have each count; ``totals``: how many tags
    have each count and number of subwords that offer it.
    """
    a = start
    c, m = (np.array(x, float) for x in zip(*((c, m) for c, m in parts.items() if c))) if any(parts) else (np.zeros(0), np.zeros(0))
    n, u, k = (np.array(x, float) for x in zip(*((n, u, k) for (n, u), k in totals.items() if n))) if any(n for n, _ in totals) else (np.zeros(0),) * 3
    for _ in range(1000):
        (c1, c2), (b1, b2), (n1, n2), (u1, u2) = (_gamma_slopes(x) for x in (a + c, np.array([a]), a * u + n, a * u))
        g = float((m * (c1 - b1)).sum() - (k * u * (n1 - u1)).sum())
        h = float((m * (c2 - b2)).sum() - (k * u * u * (n2 - u2)).sum())
        if h == 0:
            break
        step = -g / h
        a = a + step if a + step > 0 else a / 2
        if a > most:
            return 1.0
        if abs(step) < stop:
            break
    return a


def train(vocab: DataFrame, offers: DataFrame, levels: list[int], config: Config) -> tuple[DataFrame, DataFrame]:
    """The tables of subwords and of the tag models, for each level."""
    spark, sub, lm = vocab.sparkSession, None, None
    offers = keep(offers.where("tag is not null"))
    for lev in levels:
        own = offers.where(F.col("level") == lev).groupBy("word", "tag").agg(F.min("seen").alias("seen"))
        pairs = vocab.where((F.col("level") == lev) & F.isnotnull("tag"))
        aligned = keep(alignments(pairs, own))
        used = aligned.select(F.explode("parts").alias("p")).groupBy(F.col("p.subword").alias("word"), F.col("p.tag").alias("tag")).agg(F.count("*").alias("c"))
        counted = keep(own.join(used, ["word", "tag"], "left").select("word", "tag", F.coalesce("c", F.lit(0)).alias("c")))
        totals = counted.groupBy("tag").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
        # occurrences of each tag as a substring of the tags that could be aligned
        longest = counted.agg(F.coalesce(F.max(F.length("tag")), F.lit(1))).first()[0]
        at = aligned.where(F.length("tag") > 0).select("tag", F.explode(F.sequence(F.lit(1), F.length("tag"))).alias("at"))
        part = at.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("tag") - F.col("at") + 1)), lambda n: F.substr("tag", F.col("at"), n))).alias("tag"))
        occurs = part.groupBy("tag").agg(F.count("*").alias("occ"))
        # a row a distinct count
        parts = {r[0]: r[1] for r in counted.groupBy("c").count().collect()}
        a = concentration(parts, {(r[0], r[1]): r[2] for r in totals.groupBy("n", "kinds").count().collect()})
        both = counted.join(totals, "tag").join(occurs, "tag", "left")
        p = (F.col("c") + a) / (F.col("n") + a * F.col("kinds")) * F.col("n") / F.col("occ")
        own = both.where("n > 0 and occ > 0").select(F.col("word").alias("subword"), F.lit(lev).alias("level"), "tag", F.log(p).alias("logp"))
        model = ngram_lm.probabilities(ngram_lm.counts(aligned, config.lm_order, "tag")).select(F.lit(lev).alias("level"), "n", "ngram", "logp", "logbackoff")
        sub, lm = (own if sub is None else sub.unionByName(own)), (model if lm is None else lm.unionByName(model))
    if sub is None:
        from .model import LM, SUBWORDS

        return spark.createDataFrame([], SUBWORDS), spark.createDataFrame([], LM)
    return keep(sub), keep(lm)


def candidates(word: str, offers: dict[str, list[tuple[str, float]]], lm: ngram_lm.Model, beam: int = 50) -> list[tuple[str, float]]:
    """(tag, log score) of every way to write the word as subwords, as far as the beam goes (0: all)."""
    longest = max(map(len, offers), default=0)
    stack: list[list[tuple[float, str]]] = [[] for _ in range(len(word) + 1)]
    stack[0] = [(0.0, "")]
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            for tag, logp in offers.get(word[s:e], ()) if stack[s] else ():
                for score, so_far in stack[s]:
                    now, ctx = score + logp, ngram_lm.PAD * (lm.order - 1) + so_far
                    for c in tag:
                        now += lm.score(ctx, c)
                        ctx += c
                    stack[e].append((now, so_far + tag))
        if beam and len(stack[e]) > beam:
            stack[e] = sorted(stack[e], key=lambda x: (-x[0], x[1]))[:beam]
    return [(t, s + lm.score(ngram_lm.PAD * (lm.order - 1) + t, "")) for s, t in stack[-1]]


def tag_unknown(word: str, offers: dict[str, list[tuple[str, float]]], lm: ngram_lm.Model, beam: int = 50, most: int = 3, merge: bool = False) -> list[tuple[str, float]]:
    """Ranked tags whose scores sum to 1 before the cut; equal tags of different ways stay apart unless ``merge``."""
    if len(word) > LONGEST:
        return [("<NULL>", 0.0)]
    found = candidates(word, offers, lm, beam)
    if not found:
        return []
    top = max(s for _, s in found)
    raw = [(t, math.exp(s - top)) for t, s in found]
    total = sum(s for _, s in raw)
    if merge:
        sums: dict[str, float] = {}
        for t, s in raw:
            sums[t] = sums.get(t, 0.0) + s
        raw = list(sums.items())
    ranked = sorted(((t, s / total) for t, s in raw), key=lambda x: (-x[1], x[0]))
    return ranked[:most] if most else ranked


def tag_words(words: DataFrame, sub: DataFrame, lm: DataFrame, level: int, config: Config) -> DataFrame:
    """(word, rank, tag, score): the ranked tags of each word as an unknown one."""
    limited(sub, "subword")
    limited(lm, "ngram")
    offers: dict[str, list[tuple[str, float]]] = {}
    for r in sub.where(F.col("level") == level).orderBy("subword", "tag").select("subword", "tag", "logp").toArrow().to_pylist():
        offers.setdefault(r["subword"], []).append((r["tag"], r["logp"]))
    rows = [tuple(r.values()) for r in lm.where(F.col("level") == level).select("n", "ngram", "logp", "logbackoff").toArrow().to_pylist()]
    held = words.sparkSession.sparkContext.broadcast((offers, ngram_lm.Model(rows, config.lm_order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = held.value
        for b in batches:
            found = [(w, k + 1, t, s) for w in b.column(0).to_pylist() if w for k, (t, s) in enumerate(tag_unknown(w, own, model, config.beam, config.tag_max))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.float64()))], ["word", "rank", "tag", "score"])

    return words.select("word").mapInArrow(run, "word string, rank int, tag string, score double")
