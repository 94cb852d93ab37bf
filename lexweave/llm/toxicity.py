"""Operator 10: toxicity by a factorization machine over hashed terms.

A document is the set of its words (lower case, letters and digits), hashed
to 2**18 terms. The machine scores it by a bias, a weight a term, and the inner
products of the terms' factor vectors, so two terms together can weigh what
neither does alone. Weights and factors are learned from labelled documents by
AdaGrad on the log loss, for the terms that tell toxic documents from others by
a likelihood ratio test, alone or in a pair: a pair's share of toxic documents is
held against what its two terms would give if their effects added up. So both
terms of an interaction are learned though neither tells anything alone. All
other terms weigh nothing.

Training reads at most ``train_rows`` labelled documents, those with the least
hashes of their ids; scoring reads every word of every document. A document is
toxic from ``threshold`` on.

Defined results:

* Null, empty or word-free text scores by the bias alone and isn't toxic.
* Repeated words count once. Repeated rows are each scored. Null ids are scored, never trained on.
* A document with labels that contradict each other isn't trained on; null labels don't count.
* A very long text is scored by all its words. The test of pairs reads at most ``PAIR_SAMPLE`` pairs of the sample, from documents of up to ``PAIR_TERMS`` distinct terms.
* Other columns, whatever their names, aren't read.
* No usable labels, or labels of one class: nothing is toxic. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, pick
from .wordhash import chunks, span_hashes, string_bytes, word_spans

BITS = 18
FACTORS = 4
TRAIN_ROWS = 20_000
EPOCHS = 40
#: A toxic document that stays counts for more than twice a clean one that goes.
THRESHOLD = 0.3
#: Of the test of pairs: documents of the sample that a term must be in, roots of likelihood ratios, hashed counters, pairs at once.
PAIR_DOCS, PAIR_LEAST, PAIR_BITS, PAIR_CHUNK = 8, 6.0, 22, 1 << 20
#: What the test of pairs reads of the sample: documents of up to so many terms, from the first on, up to so many pairs in all.
PAIR_TERMS, PAIR_SAMPLE = 512, 50_000_000
SCHEMA = "doc_id bigint, score double, toxic boolean"


def terms(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(terms, offsets): the distinct hashed words of each text, ascending."""
    row, starts, ends = word_spans(data, offsets)
    h = (span_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.sort((row.astype(np.int64) << bits) | h)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    bounds = np.searchsorted(both, np.arange(len(offsets), dtype=np.int64) << bits)
    return both & ((1 << bits) - 1), bounds


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        score = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            at = bounds[full]
            v = self.factor[idx]
            s = np.add.reduceat(v, at, axis=0)
            score[full] += np.add.reduceat(self.weight[idx], at) + 0.5 * (s * s - np.add.reduceat(v * v, at, axis=0)).sum(1)
        return score

    def score(self, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, bounds), -30, 30)))


def telling(idx: np.ndarray, doc: np.ndarray, label: np.ndarray, bits: int, least: float) -> np.ndarray:
    """The terms whose share of toxic documents differs from the whole sample's: root of the likelihood ratio of at least ``least``."""
    n = np.bincount(idx, minlength=1 << bits).astype(float)
    hit = np.bincount(idx, label[doc], 1 << bits)
    p = label.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(hit > 0, hit * np.log(hit / (n * p)), 0) + np.where(hit < n, (n - hit) * np.log((n - hit) / (n * (1 - p))), 0)
    return 2 * np.nan_to_num(ratio) >= least * least


def _pairs(idx: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, term, later term) of all pairs within documents, some documents at a time."""
    held, size, left = [], 0, PAIR_SAMPLE
    for d, k in enumerate(np.diff(bounds)):
        if 1 < k <= PAIR_TERMS and left > 0:
            left -= k * (k - 1) // 2
            i, j = np.triu_indices(k, 1)
            own = idx[bounds[d] : bounds[d + 1]]
            held.append((np.full(len(i), d), own[i], own[j]))
            size += len(i)
            if size >= PAIR_CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _surprise(n: np.ndarray, hit: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Root of the likelihood ratio of so many toxic of ``n`` documents where ``want`` are expected."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(hit > 0, hit * np.log(hit / want), 0) + np.where(hit < n, (n - hit) * np.log((n - hit) / (n - want)), 0)
    return np.sqrt(np.maximum(2 * np.nan_to_num(ratio), 0))


def telling_pairs(idx: np.ndarray, bounds: np.ndarray, label: np.ndarray, bits: int, least: float = PAIR_LEAST) -> np.ndarray:
    """The terms of pairs whose share of toxic documents isn't what their terms' own shares add up to.

    A first pass counts pairs by hash, a second one exactly those whose counter is conspicuous.
    """
    size, p = 1 << bits, label.mean()
    doc = np.repeat(np.arange(len(label)), np.diff(bounds))
    n = np.bincount(idx, minlength=size)
    own = (np.bincount(idx, label[doc], size) + p) / (n + 1)
    odds = np.log(own / (1 - own))
    base = np.log(p / (1 - p))
    keep = n[idx] >= PAIR_DOCS
    idx = idx[keep]
    bounds = np.searchsorted(doc[keep], np.arange(len(label) + 1))
    counters = np.zeros((3, 1 << PAIR_BITS), np.float32)
    bucket = lambda i, j: ((i * size + j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    expect = lambda i, j: 1 / (1 + np.exp(base - odds[i] - odds[j]))
    for d, i, j in _pairs(idx, bounds):
        at = bucket(i, j)
        for row, weight in zip(counters, (None, label[d], expect(i, j))):
            row += np.bincount(at, weight, 1 << PAIR_BITS)
    # what shares a counter with a telling pair dampens it: the bound is lower here
    odd = _surprise(*counters.astype(np.float64)) >= 0.6 * least
    kept = []
    for d, i, j in _pairs(idx, bounds):
        here = odd[bucket(i, j)]
        kept.append((i[here] * size + j[here], label[d[here]]))
    use = np.zeros(size, bool)
    if kept:
        names, y = (np.concatenate(x) for x in zip(*kept))
        names, back, many = np.unique(names, return_inverse=True, return_counts=True)
        i, j = names // size, names % size
        hit = _surprise(many.astype(float), np.bincount(back, y, len(names)), many * expect(i, j)) >= least
        use[i[hit]] = use[j[hit]] = True
    return use


def fit(idx: np.ndarray, bounds: np.ndarray, label: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, least: float = 3.0, rate: float = 0.3, shrink: float = 5e-5, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """The machine trained on these documents; only terms that tell, alone or in pairs, weigh anything."""
    doc = np.repeat(np.arange(len(label)), np.diff(bounds))
    use = telling(idx, doc, label, bits, least) | telling_pairs(idx, bounds, label, bits)
    keep = use[idx]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(label)))])
    idx, rng = idx[keep], np.random.default_rng(seed)
    size = 1 << bits
    w, b = np.zeros(size), float(np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6)))
    v = np.where(use[:, None], rng.normal(0, 0.1, (size, factors)), 0)
    gw, gv = np.full(size, 1e-2), np.full(size, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            # documents without any of the terms teach the bias
            bare = bounds[rows + 1] == bounds[rows]
            b -= 0.1 * float((1 / (1 + np.exp(-b)) - label[rows[bare]]).sum()) / len(rows)
            rows = rows[~bare]
            if not len(rows):
                continue
            many = bounds[rows + 1] - bounds[rows]
            edge = np.concatenate([[0], np.cumsum(many)])
            i = idx[np.repeat(bounds[rows] - edge[:-1], many) + np.arange(edge[-1])]
            of = np.repeat(np.arange(len(rows)), many)
            vi = v[i]
            s = np.add.reduceat(vi, edge[:-1], axis=0)
            raw = b + np.add.reduceat(w[i], edge[:-1]) + 0.5 * (s * s - np.add.reduceat(vi * vi, edge[:-1], axis=0)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(bare)
            b -= 0.1 * float(g.sum())
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, g[of], len(uniq))
            gw[uniq] += dw * dw
            step = rate / np.sqrt(gw[uniq])
            new = w[uniq] - step * dw
            w[uniq] = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
            pair = g[of][:, None] * (s[of] - vi)
            dv = np.stack([np.bincount(back, pair[:, f], len(uniq)) for f in range(factors)], 1)
            # one step size for a term's vector, which a group penalty draws to 0
            gv[uniq] += (dv * dv).sum(1)
            step = 0.1 / np.sqrt(gv[uniq])[:, None]
            new = v[uniq] - step * dv
            v[uniq] = new * np.maximum(0, 1 - step * decay / (np.sqrt((new * new).sum(1))[:, None] + 1e-12))
    return Machine(b, w, v)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = string_bytes(b.column("text"))
        for lo, hi in chunks(offsets):
            idx, bounds = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([b.column("label").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(idx.astype(np.int32)))], ["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> Machine | None:
    """A machine from a bounded sample of the labelled documents."""
    marks = pick(labels, id="doc_id:bigint", label="toxic:int").where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    marks = marks.where("label = most").select("id", "label").orderBy(F.xxhash64("id"), "id").limit(train_rows)
    marks = cut(marks)
    # at most train_rows rows: the bound is what is sent
    rows = pick(docs, id="doc_id:bigint", text="text").where("id is not null and text is not null").join(F.broadcast(marks), "id").select("label", F.lower("text").alias("text"))
    sample = rows.mapInArrow(_features, "label int, terms array<int>").toArrow()
    label = sample.column("label").to_numpy().astype(float)
    if not len(label) or label.min() == label.max():
        return None
    lists = sample.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return fit(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), label, **options)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    machine = train(docs, labels, **options)
    sc = docs.sparkSession.sparkContext
    # the terms that weigh anything: its size is bounded by 2**18 terms, whatever the corpus
    held = sc.broadcast(machine and (machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value and Machine(*held.value)
        for b in batches:
            data, offsets = string_bytes(b.column("text"))
            for lo, hi in chunks(offsets):
                score = np.zeros(hi - lo)
                if model:
                    idx, bounds = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    score = model.score(idx, bounds)
                    hit = (score >= threshold) & (np.diff(bounds) > 0)
                else:
                    hit = np.zeros(hi - lo, bool)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(score), pa.array(hit)], ["doc_id", "score", "toxic"])

    return pick(docs, id="doc_id:bigint", text="text").select("id", F.lower("text").alias("text")).mapInArrow(run, SCHEMA)


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score) of the toxic documents."""
    return score_documents(docs, labels, **options).where("toxic").select("doc_id", "score")
