import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import packing, queries


def brute(sizes, capacity):
    """Fills of windows after each piece goes where the sum of squared counts becomes least; ties: the fullest."""
    fill, out = [], []
    for item, size in enumerate(sizes):
        start = 0
        while size - start >= capacity:
            fill.append(capacity)
            out.append((item, start, capacity, len(fill) - 1, 0))
            start += capacity
        s = size - start
        if not s:
            continue

        def cost(level):
            now = [f for f in fill if 0 < f < capacity]
            if level:
                now.remove(level)
            counts = np.bincount([f for f in [*now, level + s] if f < capacity] or [0], minlength=capacity)
            return int((counts[1:] ** 2).sum())

        level = min({0, *[f for f in fill if f + s <= capacity]}, key=lambda f: (cost(f), -f))
        if level:
            w = max(i for i, f in enumerate(fill) if f == level)
            out.append((item, start, s, None, level))
            fill[w] += s
        else:
            fill.append(s)
            out.append((item, start, s, None, 0))
    return out, sorted(fill)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 40), max_size=40), st.integers(2, 16))
def test_against_brute_force(sizes, capacity):
    got = packing.pack(sizes, capacity)
    want, fills = brute(sizes, capacity)
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    held = {}
    for _, _, n, w, off in got:
        assert held.get(w, 0) == off
        held[w] = off + n
    assert sorted(held.values()) == fills and all(v <= capacity for v in held.values())


def test_query_places_every_token_once(spark, sf):
    got = queries.op2_sum_of_squares_packing(spark, sf).toPandas()
    library = sentencepiece.SentencePieceProcessor(model_file=packing.MODEL)
    sizes = {r.doc_id: len(library.encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    assert got.groupby("doc_id").tokens.sum().to_dict() == sizes
    for _, w in got.sort_values("offset").groupby(["shard", "window"]):
        assert list(w.offset) == [0, *np.cumsum(w.tokens)[:-1]] and w.tokens.sum() <= packing.CAPACITY
    order = got.sort_values(["doc_id", "start"])
    fresh = packing.pack([sizes[d] for d in sorted(sizes)], packing.CAPACITY)
    slow, _ = brute([sizes[d] for d in sorted(sizes)], packing.CAPACITY)
    assert [(n, o) for _, _, n, _, o in fresh] == [(n, o) for _, _, n, _, o in slow]
    if got.shard.nunique() == 1:
        assert [tuple(x) for x in order[["tokens", "window", "offset"]].to_numpy()] == [(n, w, o) for _, _, n, w, o in fresh]


def test_odd_rows(spark, odd, make):
    got = packing.pack_documents(odd, unit="words").collect()
    assert sorted({str(r.doc_id) for r in got}) == ["1", "5", "None"] and sum(r.tokens for r in got) == 12 + 2 + 100_000
    assert packing.pack_documents(odd.limit(0)).collect() == []
    many = packing.pack_documents(odd, capacity=8, windows_a_shard=100, unit="words").toPandas()
    assert many.shard.nunique() > 1 and many.tokens.sum() == 100_014
    pieces = packing.pack_documents(odd).toPandas()
    assert {str(x) for x in pieces.doc_id.astype("Int64").astype(str)} == {"1", "4", "5", "<NA>"}
    none = make(*[(None, f"text {i} of none") for i in range(60)])
    assert packing.pack_documents(none, capacity=8, windows_a_shard=2).toPandas().shard.nunique() > 3
    assert packing.pack_documents(none.limit(0)).collect() == []
