import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import pieces, queries
from lexweave.llm.wordhash import mix, string_bytes


def run(texts, dropout, keys=None):
    data, offsets = string_bytes(pa.array(texts, pa.string()))
    p = pieces.load(pieces.MODEL)
    keys = np.arange(len(texts), dtype=np.uint64) if keys is None else keys
    ids, bounds = pieces.encode(p, data, offsets, keys, dropout)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], p


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_without_dropout_as_the_library(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t) and "\0" not in t]
    got, _ = run(texts, 0.0)
    assert got == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=200), st.floats(0, 1), st.integers(0, 2**64 - 1))
def test_decodes_losslessly(text, dropout, key):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    (ids,), p = run([text], dropout, np.array([key], np.uint64))
    back = p.decode(pa.array([ids], pa.list_(pa.int32())))[0].as_py()
    assert back == text.replace("▁", " ")


def brute(p, sp, text, key, dropout):
    """An agenda of one text, candidate by candidate."""
    c = [chr(pieces.MARK), *text.replace(" ", chr(pieces.MARK))] if text else []
    start = list(range(len(c) + 1))
    limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
    dropped = set()
    while True:
        best = None
        for i in range(len(c) - 1):
            span = (start[i], start[i + 1], start[i + 2])
            k = sp.piece_to_id(c[i] + c[i + 1])
            if span in dropped or sp.is_unknown(k) or sp.is_byte(k) or sp.is_control(k):
                continue
            if best is None or sp.get_score(k) > best[0]:
                best = (sp.get_score(k), i, span)
        if best is None:
            break
        _, i, span = best
        a, b, z = (np.array([x]) for x in span)
        if dropout and pieces._skipped(np.array([key]), a, b, z, limit)[0]:
            dropped.add(span)
            continue
        c[i : i + 2] = [c[i] + c[i + 1]]
        del start[i + 1]
    out = []
    for s in c:
        k = sp.piece_to_id(s)
        out += [k] if not sp.is_unknown(k) else [sp.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return out


def test_dropout_against_brute_force():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["the internationalization of  words", "déjà vu 日本語 🎉", "", "aaaaaaa bbb", "x = foo(bar);\n\tend"]
    keys = mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    for dropout in (0.1, 0.5, 1.0):
        got, p = run(texts, dropout, keys)
        assert got == [brute(p, sp, t, k, dropout) for t, k in zip(texts, keys)]


def test_seeds_and_batches_decide_nothing_else(spark, make):
    docs = make(*[(i, "the internationalization of words and sentences " * 3) for i in range(20)])
    ids = lambda df: {r.doc_id: r.ids for r in df.collect()}
    a, b = ids(pieces.encode_documents(docs)), ids(pieces.encode_documents(docs.repartition(7)))
    assert a == b and len({tuple(x) for x in a.values()}) > 10
    assert ids(pieces.encode_documents(docs, seed=1)) != a
    with pytest.raises(ValueError):
        pieces.encode_documents(docs, dropout=2)


def test_query_round_trips(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = queries.op4_merge_dropout(spark, sf)
    back = got.join(docs, "doc_id").withColumn("back", pieces.decode(F.col("ids")))
    assert back.where("round_trip and back = replace(text, '▁', ' ') and pieces = size(ids)").count() == docs.count()


def test_odd_rows(spark, odd):
    got = pieces.encode_documents(odd).collect()
    assert len(got) == 8
    assert sum(r.ids is None for r in got) == 2 and all(r.round_trip for r in got if r.ids is not None)
    assert [r.ids for r in got if r.doc_id == 3] == [[]]
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    assert pieces.encode_documents(odd.limit(0)).collect() == []
