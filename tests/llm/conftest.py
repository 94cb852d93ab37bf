import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def build(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, and columns that clash."""
    long = "lorem ipsum dolor sit amet\n" * 20_000
    rows = [(1, "a b c\nd e f", "x", "s", 11), (1, "a b c\nd e f", "x", "s", 11), (2, None, None, None, None), (None, "alone here", "y", "s", 10), (3, "", "y", None, 0), (4, " \n\t\n", "y", "s", 4), (5, long, "y", "s", len(long)), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", F.lit(7).alias("_key"), F.lit(8).alias("key"), F.lit("z").alias("TEXT"), F.lit(9).alias("id"), F.lit(1).alias("_c0"), F.lit("h").alias("host"), F.lit(2).alias("_removed"))
