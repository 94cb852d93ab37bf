"""Results that depend on size: partitions computed twice, batches, tables that are too large to send."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.operators import ngrams, vocabulary
from lexweave.sources import formats


def test_numbers_are_dense_where_rows_come_in_another_order_each_time(spark):
    def shuffled(batches):
        for b in batches:
            yield b.take(np.random.default_rng().permutation(len(b)))

    rows = spark.range(0, 40_000, 1, 3).selectExpr("id * 7 as seen").mapInArrow(shuffled, "seen bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as a large table has
    got = sorted(tuple(r) for r in vocabulary.number_rows(rows, [F.col("seen")]).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(7 * i, i + 1) for i in range(40_000)]


def test_partial_lines_by_array_equal_those_read_unit_by_unit():
    # a slash in the place of a character is one: it was taken for the begin of a tag
    got = formats.read_partial.kernel(pa.array(["é /?b", "a-b/T|c"])).to_pylist()
    assert [w["surface"] for w in got[0]["words"]] == ["é/b"] == [got[0]["surface"]] and got[0]["words"][0]["tags"] == []
    assert [(w["surface"], len(w["tags"])) for w in got[1]["words"]] == [("ab", 1), ("c", 0)]
    rng = random.Random(5)
    lines = ["".join(rng.choices("ab/|-? é&\\", [9, 9, 3, 3, 5, 2, 5, 1, 1, 1], k=rng.randint(0, 9))) for _ in range(4000)]
    good = []
    for line in lines:
        try:
            good.append((line, formats._odd_partial(formats._hold(pa.array([line]))[0].as_py(), line)))
        except ValueError:
            with pytest.raises(ValueError):
                formats.read_partial.kernel(pa.array([line]))
    assert len(good) > 500 and formats.read_partial.kernel(pa.array([g[0] for g in good])).to_pylist() == [g[1] for g in good]


def test_addressed_tables_equal_hashed_ones(monkeypatch):
    rng = random.Random(7)
    grams = list({("X", "".join(rng.choices("ab1漢。", k=rng.randint(1, 3)))) for _ in range(60)} | {("T", "".join(rng.choices("RDKO", k=rng.randint(1, 3)))) for _ in range(40)})
    weights = np.random.default_rng(1).integers(-900, 900, (len(grams), 6))
    weights[:, 5][[len(g) > 1 for _, g in grams]] = 0
    weights[:, 4][[len(g) > 2 for _, g in grams]] = 0
    flat, bounds = ngrams.codes(["".join(rng.choices("ab1漢。z𠀀", k=rng.randint(0, 9))) for _ in range(50)])
    line, room = ngrams._layout(bounds)
    score = lambda: ngrams.Lookup([k for k, _ in grams], [g for _, g in grams], weights, 3).score(flat, bounds, line, room)[room > 1]
    direct = score()
    monkeypatch.setattr(ngrams, "DIRECT", 0)
    assert (score() == direct).all() and len(direct) > 100


def test_a_task_keeps_the_least_certain_boundary_of_each_pair(spark):
    rows = spark.createDataFrame([(1, "abab", [5, -7, 4]), (2, "ab", [-4]), (3, "a", [])], "id int, norm string, scores array<bigint>").coalesce(1)
    got = sorted(tuple(r) for r in ngrams.least_of_pairs(rows, ["id"]).collect())
    assert got == [(1, 1, -7, "ba"), (1, 2, 4, "ab"), (2, 0, -4, "ab")]
