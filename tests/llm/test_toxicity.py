import random

import numpy as np
import pyarrow as pa

from lexweave.llm import queries, toxicity
from lexweave.llm.wordhash import string_bytes

LABELS = "doc_id bigint, quality int, toxic int"


def features(texts):
    return toxicity.terms(*string_bytes(pa.array(texts)))


def test_interactions_are_learned():
    """Toxic only where an insult meets a group: no additive weights tell that from either alone."""
    rng = random.Random(0)
    texts, label = [], []
    for _ in range(4000):
        kind = rng.randrange(4)
        text = [f"w{rng.randrange(300)}" for _ in range(12)] + ["insult"] * (kind & 1) + ["group"] * (kind >> 1)
        texts.append(" ".join(text))
        label.append(float(kind == 3))
    y = np.array(label)
    m = toxicity.fit(*features(texts[:3000]), y[:3000])
    hit = m.score(*features(texts[3000:])) >= 0.5
    assert (hit == (y[3000:] > 0)).mean() > 0.97
    i, g = (int(features([w])[0][0]) for w in ("insult", "group"))
    assert m.factor[i] @ m.factor[g] > 1


def additive(idx, bounds, label):
    """Logistic regression over all terms by Newton's method: the best that weights alone can do."""
    names, back = np.unique(idx, return_inverse=True)
    x = np.zeros((len(label), len(names) + 1))
    x[np.repeat(np.arange(len(label)), np.diff(bounds)), back] = 1
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (p - label) + 1e-2 * w)
    return names, w


def test_terms_that_tell_nothing_alone():
    """Toxic where exactly one of two words stands: no term has an effect of its own, and no weights can tell."""
    for seed in range(3):
        rng = random.Random(seed)
        texts, label = [], []
        for _ in range(4000):
            kind = rng.randrange(4)
            texts.append(" ".join([f"w{rng.randrange(60)}" for _ in range(12)] + ["insult"] * (kind & 1) + ["group"] * (kind >> 1)))
            label.append(float(kind in (1, 2)))
        y = np.array(label)
        held = features(texts[3000:])
        m = toxicity.fit(*features(texts[:3000]), y[:3000])
        assert ((m.score(*held) >= 0.5) == (y[3000:] > 0)).mean() > 0.98
        names, w = additive(*features(texts[:3000]), y[:3000])
        known = dict(zip(names.tolist(), w))
        raw = np.array([w[-1] + sum(known.get(int(t), 0) for t in held[0][a:z]) for a, z in zip(held[1], held[1][1:])])
        assert ((raw >= 0) == (y[3000:] > 0)).mean() < 0.6


def test_a_rare_pair_among_many_words():
    """Group mentions as common in clean documents and insults quoted harmlessly: toxic only together."""
    rng = random.Random(5)
    texts, label = [], []
    for _ in range(6000):
        a, b = rng.random() < 0.08, rng.random() < 0.08
        if rng.random() < 0.03:
            a = b = True
        other = rng.random() < 0.1  # toxic for other reasons: so neither word stands out
        toxic = (a and b) or (other and not a and not b) or (a != b and rng.random() < 0.05)
        texts.append(" ".join([f"w{int(rng.paretovariate(0.8)) % 4000}" for _ in range(60)] + ["insult"] * a + ["group"] * b + ["vile"] * (toxic and not a and not b)))
        label.append(float(toxic))
    y = np.array(label)
    m = toxicity.fit(*features(texts[:4000]), y[:4000])
    idx, bounds = features(texts[4000:])
    i, g = (int(features([w])[0][0]) for w in ("insult", "group"))
    both = np.array([i in idx[lo:hi] and g in idx[lo:hi] for lo, hi in zip(bounds, bounds[1:])])
    one = np.array([(i in idx[lo:hi]) != (g in idx[lo:hi]) for lo, hi in zip(bounds, bounds[1:])])
    hit = m.score(idx, bounds) >= 0.5
    assert hit[both].mean() > 0.95 and hit[one].mean() < 0.05 and both.sum() > 50


def test_pairs_are_tested_against_added_effects():
    """A telling word doesn't make pairs with common words tell."""
    rng = random.Random(6)
    texts, label = [], []
    for _ in range(2000):
        toxic = rng.random() < 0.2
        texts.append(" ".join([f"w{rng.randrange(40)}" for _ in range(10)] + ["vile"] * toxic))
        label.append(float(toxic))
    assert toxicity.telling_pairs(*features(texts), np.array(label), toxicity.BITS).sum() == 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = labels.where("doc_id % 3 = 0")
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, labels.where("doc_id % 3 <> 0")).collect()}
    rows = [(r.toxic, got[r.doc_id]) for r in odd.dropDuplicates(["doc_id"]).collect() if r.doc_id in got]
    caught = sum(bool(t and g) for t, g in rows) / max(1, sum(bool(t) for t, _ in rows))
    false = sum(bool(g and not t) for t, g in rows) / max(1, sum(not t for t, _ in rows))
    # one in twelve of the toxic labels is on a text without any telling word
    assert caught >= 0.85 and false <= 0.005, (caught, false)


def test_query_against_its_own_scores_by_hand(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    rows = docs.collect()
    idx, bounds = features([(r.text or "").lower() for r in rows])
    want = []
    for k, r in enumerate(rows):
        own = idx[bounds[k] : bounds[k + 1]]
        pairs = sum(float(m.factor[a] @ m.factor[b]) for n, a in enumerate(own) if m.factor[a].any() for b in own[:n] if m.factor[b].any())
        score = 1 / (1 + np.exp(-(m.bias + m.weight[own].sum() + pairs)))
        if score >= toxicity.THRESHOLD:
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in queries.op10_fm_toxicity(spark, sf).collect()) == sorted(want)


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.score_documents(odd, none).collect()
    assert len(got) == 8 and not any(r.toxic for r in got)
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, None, None), (None, 1, 1), (3, 0, 0)], LABELS)
    assert not any(r.toxic for r in toxicity.score_documents(odd, one).collect())
    assert toxicity.score_documents(odd.limit(0), one).collect() == []
    two = spark.createDataFrame([(1, 1, 1), (5, 1, 0)], LABELS)
    assert len(toxicity.score_documents(odd, two).collect()) == 8
