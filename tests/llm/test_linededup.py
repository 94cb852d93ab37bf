import random

import numpy as np

from lexweave.llm import linededup, queries

P = [f"passage line {i} with quite a few words so that ten of them make a run" for i in range(8)]


def texts(df):
    return {r[0]: r[1] for r in df.select("_c0", "_c1").collect()}


def norm(line):
    return " ".join(line.lower().split())


def runs(own, min_words):
    """The shortest runs of enough words from each line on and back from each."""
    size = [len(x.split(" ")) for _, x in own]
    out = set()
    for i in range(len(own)):
        for step in (1, -1):
            z, n = i, 0
            while 0 <= z < len(own):
                n += size[z]
                if n >= min_words:
                    out.add((min(i, z), max(i, z)))
                    break
                z += step
    return out


def brute(docs, min_words):
    """A line goes if it lies in a run of enough words that occurs at an earlier place too."""
    lines = {d: [(i, norm(x)) for i, x in enumerate(t.split("\n")) if norm(x)] for d, t in docs}
    found = [(tuple(x for _, x in lines[d][a : z + 1]), k, a, z, d) for k, (d, _) in enumerate(docs) for a, z in runs(lines[d], min_words)]
    first, gone = {}, {d: set() for d, _ in docs}
    for run, k, a, *_ in found:
        first[run] = min(first.get(run, (k, a)), (k, a))
    for run, k, a, z, d in found:
        if first[run] < (k, a):
            gone[d] |= {i for i, _ in lines[d][a : z + 1]}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_later_copies_of_a_passage_go(spark, make):
    docs = make((1, "\n".join(["start", *P, "end"])), (2, "\n".join(["other", *P, "tail"])), (3, "\n".join(P[:2])), (4, "\n".join([*P[2:], "", *P[2:]])))
    got = texts(linededup.dedup_lines(docs))
    assert got[1] == "\n".join(["start", *P, "end"]) and got[2] == "other\ntail" and got[3] == "\n".join(P[:2]) and got[4] == ""


def test_against_brute_force(spark, make):
    rng = random.Random(2)
    pool = [f"line {i} " + " ".join(f"t{rng.randrange(99)}" for _ in range(rng.randrange(3, 20))) for i in range(40)]
    docs = []
    for d in range(40):
        body = [f"own {d} {k} word" for k in range(rng.randrange(1, 6))]
        if rng.random() < 0.7:
            a = rng.randrange(30)
            at = rng.randrange(len(body) + 1)
            body[at:at] = pool[a : a + rng.randrange(1, 12)]
        docs.append((d, "\n".join(body)))
    want = brute(docs, linededup.MIN_WORDS)
    assert any(want[d] != t for d, t in docs)
    for hot in (0, 1, 3, linededup.HOT, 1000):
        assert texts(linededup.dedup_lines(make(*docs), hot=hot)) == want, hot


def test_a_passage_goes_whatever_earlier_place_shares_most_of_it(spark, make):
    """P alone comes first, then P and Q twice: Q goes from the last."""
    p, q = "\n".join(P[:4]), "one more paragraph of ten words or so stands here"
    docs = [(1, p), (2, f"{p}\n{q}"), (3, f"{p}\n{q}\nown words")]
    for hot in (0, 8):
        assert texts(linededup.dedup_lines(make(*docs), hot=hot)) == {1: p, 2: q, 3: "own words"} == brute(docs, linededup.MIN_WORDS)


def test_japanese_lines_count_by_characters(spark, make):
    passage = "\n".join("吾輩は猫である名前はまだ無い" + c for c in "一二三四五")
    docs = [(1, f"始\n{passage}"), (2, f"{passage}\n終わり"), (3, passage.split("\n")[0])]
    assert texts(linededup.dedup_lines(make(*docs))) == {1: docs[0][1], 2: "終わり", 3: docs[2][1]}


def test_postings_are_the_selected_minima():
    """Both guarantees: only window minima are posted, and every window has one; equal runs select equal lines."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(0, 30, 4)
        hs, ws = rng.integers(-50, 50, sizes.sum()), rng.integers(1, 12, sizes.sum())
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        got = set(linededup.selected(hs, ws, offsets, 20).tolist())
        want = set()
        for lo, hi in zip(offsets, offsets[1:]):
            own = [(i, " ".join("x" * ws[i])) for i in range(lo, hi)]
            for a, z in runs(own, 20):
                want.add(min(range(lo + a, lo + z + 1), key=lambda i: (int(hs[i]) % 2**64, i)))
        assert got == want
        assert len(got) <= len(hs)
    hs, ws = rng.integers(-(2**60), 2**60, 5000), np.full(5000, 5)
    share = len(linededup.selected(hs, ws, np.array([0, 5000]), 50)) / 5000
    assert 0.12 < share < 0.25  # windows of ten lines: two in eleven
    a, b = (set(hs[linededup.selected(hs[x:y], ws[x:y], np.array([0, y - x]), 50) + x].tolist()) for x, y in ((100, 400), (380, 600)))
    assert a & b  # they share the lines from 380 on


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text]
    got = {r.doc_id: r.text for r in queries.op7_line_winnowing(spark, sf).collect()}
    assert {d: got[d] for d, _ in docs} == brute(docs, linededup.MIN_WORDS)


def test_odd_rows(spark, odd, make):
    got = linededup.dedup_lines(odd)
    assert len(got.columns) == len(odd.columns) + 1
    rows = got.collect()
    assert len(rows) == 8 and sorted(r._removed for r in rows)[-1] > 19_000 and sum(r[1] is None for r in rows) == 2
    a, b = (linededup.dedup_lines(odd, broadcast_bytes=n, hot=h) for n, h in ((1 << 25, 8), (0, 0)))
    assert a.exceptAll(b).count() == 0
    short = make((1, "a few words"), (2, "a few words"), (None, "\n".join(P)), (None, "\n".join(P)), (7, "\n \n".join(P)))
    assert sorted(map(repr, ((r[0], r[1]) for r in linededup.dedup_lines(short).collect()))) == sorted(map(repr, [(1, "a few words"), (2, "a few words"), (None, ""), (None, ""), (7, "\n \n".join(P))]))
    assert linededup.dedup_lines(odd.limit(0)).collect() == []
