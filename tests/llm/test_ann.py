import numpy as np
import pytest

from lexweave.llm import ann, queries

VEC = "vec_id bigint, embedding array<float>, label int"


def exact(vectors, asked, k):
    d = ((vectors[asked][:, None] - vectors[None]) ** 2).sum(-1)
    d[np.arange(len(asked)), asked] = np.inf
    return np.argsort(d, 1, kind="stable")[:, :k]


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], VEC)


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    if kind == "clusters":
        v = (rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] + 0.2 * v).astype(np.float32)
    got = ann.neighbours(frame(spark, v), every=10).toPandas()
    asked = np.arange(0, 3000, 10)
    want = {(int(q), int(x)) for q, near in zip(asked, exact(v.astype(float), asked, 10)) for x in near}
    assert len(want & set(zip(got.vec_id, got.neighbor_id))) >= 0.9 * len(want)
    assert set(got.vec_id) == set(asked) and set(got.groupby("vec_id").size()) == {10}
    for q, x, d in got[["vec_id", "neighbor_id", "distance"]].head(300).itertuples(index=False):
        assert d == pytest.approx(np.linalg.norm(v[int(q)].astype(float) - v[int(x)].astype(float)), abs=1e-6)
    assert all(g.distance.is_monotonic_increasing for _, g in got.sort_values(["vec_id", "rank"]).groupby("vec_id"))


@pytest.mark.parametrize("sf_dir, least", [("/root/testdata/sf0.001", 0.9), ("/root/testdata/sf0.1", 0.9)])
def test_query_on_the_table_against_brute_force(spark, sf_dir, least):
    got = queries.op1_permutation_index(spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    asked = [k for k, i in enumerate(ids) if i % 100 == 0]
    want = {(ids[q], ids[int(x)]) for q, near in zip(asked, exact(v, asked, 10)) for x in near}
    assert len(want & set(zip(got.vec_id, got.neighbor_id))) >= least * len(want)
    assert set(got.vec_id) == {ids[q] for q in asked}


def test_closeness_is_the_footrule():
    rng = np.random.default_rng(7)
    order = np.stack([rng.permutation(40)[:12] for _ in range(50)]).astype(np.int16)
    files = ann.Files(order, 40)
    for q in order[:10]:
        want = []
        for x in order:
            place = [{p: i for i, p in enumerate(o)} for o in (q.tolist(), x.tolist())]
            want.append(sum(abs(place[0].get(p, 12) - place[1].get(p, 12)) for p in range(40)))
        got = files.closeness(q.astype(np.int64))
        assert (2 * got + want == 12 * 13).all()


def test_the_best_by_footrule_are_reranked_and_no_others():
    score, key = np.array([5, 0, 7, 5, 5, 9, 1.0]), np.array([30, 1, 2, 10, 20, 3, 4])
    assert set(ann.best(score, 4, key)) == {5, 2, 3, 4} and set(ann.best(score, 10, key)) == {0, 2, 3, 4, 5, 6}


def test_shards_and_blocks_keep_the_best(spark):
    v = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    one, many = (set(map(tuple, ann.neighbours(frame(spark, v), pivots=40, prefix=20, every=3, depth=12, tile=t).select("vec_id", "neighbor_id").collect())) for t in (4096, 50))
    assert len(one & many) >= 0.97 * len(one) and len(one) == len(many) == 2000


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (3, [0.0, -0.0], 0), (4, None, 0), (5, [], 0), (6, [1.0, float("nan")], 0), (7, [1.0, None], 0), (8, [1.0, 2.0, 3.0], 0), (9, [inf, 0.0], 0), (10, [1.0, -inf], 0), (11, [1.0, 2.0, 4.0], 0)]
    got = ann.neighbours(spark.createDataFrame(rows, VEC).selectExpr("*", "1 as key", "2 as id", "3 as VEC"), pivots=4, every=1).orderBy("vec_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r.neighbor_id)
    assert by == {1: [2, 3, None], 2: [1, 3, None], 3: [1, 2, None], 8: [11], 11: [8]}
    assert ann.neighbours(spark.createDataFrame([], VEC)).collect() == []
    assert ann.neighbours(spark.createDataFrame(rows[:1], VEC), every=1).collect() == []
    assert ann.neighbours(spark.createDataFrame(rows, VEC)).collect() == []  # no id is divisible by 100
    wide = spark.createDataFrame([(0, [1e300, 0.0]), (100, [1.0, 0.0]), (200, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.neighbor_id, r.distance) for r in ann.neighbours(wide).collect()) == [(100, 200, 1.0), (200, 100, 1.0)]


def test_many_copies(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(50)] + [(99, [0.0, 1.0], 0)]
    got = ann.neighbours(spark.createDataFrame(rows, VEC), pivots=8, every=3).toPandas().sort_values(["vec_id", "rank"])
    assert list(got[got.vec_id == 30].neighbor_id) == list(range(10))
    assert list(got[got.vec_id == 3].neighbor_id) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert list(got[got.vec_id == 99].neighbor_id) == list(range(10))
