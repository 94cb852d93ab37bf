import numpy as np

from lexweave.llm import queries, sharding


def test_a_permutation_with_an_inverse():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p) == list(range(n)) and list(sharding.unpermute(p, n)) == list(range(n))
    a, b = sharding.permute(np.arange(1000), 1000), sharding.permute(np.arange(1000), 1000, key=1)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.1


def test_odd_rows(spark, odd):
    got = sharding.feistel_shards(odd, shards=3).collect()
    assert sorted(r.row_number for r in got) == list(range(8)) and sorted(r.position for r in got) == list(range(8))
    assert [str(r.doc_id) for r in sorted(got, key=lambda r: r.row_number)] == ["1", "1", "2", "3", "4", "5", "None", "None"]
    assert all(r.shard == r.position % 3 and r.slot == r.position // 3 for r in got)
    assert sharding.feistel_shards(odd.limit(0)).collect() == []
    assert [tuple(r) for r in sharding.feistel_shards(odd.limit(1)).collect()] == [(1, 0, 0, 0, 0)]


def test_query_against_sql(spark, sf, duck):
    got = queries.op9_feistel_shards(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(f"SELECT doc_id, row_number, position, shard, slot FROM ({queries.SQL['op9_feistel_shards']})").fetchall())
