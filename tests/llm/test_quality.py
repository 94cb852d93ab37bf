from pyspark.sql import functions as F

from lexweave.llm import quality, queries


def test_frequent_lines_go_and_depleted_documents_with_them(spark, make):
    docs = [(i, f"Subscribe  NOW\nown words of document {i} stay here", "a") for i in range(20)]
    docs += [(100, "subscribe now\n x", "a"), (101, "subscribe now", "b"), (102, "Subscribe now \n" + "long enough text " * 9, "a")]
    got = {r.doc_id: (r.text, r._removed) for r in quality.line_frequency_filter(make(*docs)).selectExpr("_c0 as doc_id", "_c1 as text", "_removed").collect()}
    assert 100 not in got and got[101] == ("subscribe now", 0)
    assert got[5] == ("own words of document 5 stay here", 1) and got[102] == ("long enough text " * 9, 1)


def test_copies_count_once(spark, make):
    got = quality.line_frequency_filter(make(*[(i, "the same line\nand another one", "a") for i in range(50)])).collect()
    assert len(got) == 50 and all(r._removed == 0 for r in got)


def test_the_share_asks_for_a_bounded_count(spark):
    """1,001 of 150,000 documents are under 1% of the host, but over the absolute count; 1,000 aren't."""
    n = F.col("id")
    text = F.concat(F.lit("own words of "), n, F.when(n < 1001, "\nSubscribe now").otherwise(""), F.when(n < 1000, "\nRead more").otherwise(""))
    docs = spark.range(150_000).select(n.alias("doc_id"), text.alias("text"), F.lit("hot").alias("source"))
    got = quality.line_frequency_filter(docs).where("_c0 < 1002").select("_c0", "_c1", "_removed").collect()
    assert {r[0]: (r[1].split("\n")[1:], r[2]) for r in got} == {i: (["Read more"] if i < 1000 else [], int(i < 1001)) for i in range(1002)}


def test_both_ways_of_marking_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (quality.line_frequency_filter(docs, max_docs=2, max_share=0.001, broadcast_bytes=n) for n in (1 << 25, 0))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_null_hosts_are_one_host(spark):
    rows = [(i, f"own words of document {i} are these\nfooter of no host", None) for i in range(12)] + [(50, "words of a host\nfooter of no host", "a"), (None, "kept without an id", None)]
    got = quality.line_frequency_filter(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    by = {r[0]: (r[1], r._removed) for r in got}
    assert by[3] == ("own words of document 3 are these", 1) and by[50] == (rows[12][1], 0) and by[None] == ("kept without an id", 0) and len(got) == 14


def test_odd_rows(spark, odd):
    got = quality.line_frequency_filter(odd)
    assert len(got.columns) == len(odd.columns) + 1
    assert sorted((str(r[0]), r[1][:5]) for r in got.collect()) == [("1", "a b c")] * 2 + [("5", "lorem"), ("None", "alone")]
    assert quality.line_frequency_filter(odd.limit(0)).collect() == []


def test_query_against_sql(spark, sf, duck):
    got = queries.op5_line_frequency(spark, sf).toPandas()
    want = duck.execute(queries.SQL["op5_line_frequency"]).df()
    key = lambda df: sorted(zip(df.doc_id, df.text, df.lines_removed))
    assert key(got) == key(want)
