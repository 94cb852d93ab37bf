"""Operator 5: cross-document line frequency.

A line is normalised (lower case, runs of white space to one blank, trimmed)
and hashed with its host. A line that occurs in more distinct documents of a
host than both limits allow (``max_docs``, and ``max_share`` of the host's
distinct documents) is boilerplate there and is removed from all documents of
that host. The share asks for ``ENOUGH_DOCS`` documents at most, so that a line
in more of them goes however large the host is. A document that keeps less than ``min_keep`` of its characters is
rejected as depleted.

Defined results:

* Documents with equal text count once, so copies don't make their own lines boilerplate.
* Null, empty or blank text: rejected, nothing is left of it. Blank lines are never removed.
* Null host: a host of its own. Null id: kept or rejected like any other.
* Repeated rows: each is kept or rejected alike. Empty table: empty result.
* A document that loses no line keeps its text byte for byte. Very long texts are read whole.
* Other columns are kept as they are, whatever their names; ``n_chars`` follows the text.
* Lines are told apart by a hash of 64 bits with that of their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, cut, fits, hide, pick

MAX_DOCS = 10
MAX_SHARE = 0.01
MIN_KEEP = 0.5
#: Where the share's demand stops: with 1%, from 100,000 documents of a host on.
ENOUGH_DOCS = 1000


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def host_key(source: Column) -> Column:
    return F.xxhash64(source, F.isnull(source))


def line_hashes(text: Column) -> Column:
    """Hashes of the normalised lines that aren't blank."""
    lines = F.transform(F.split(text, "\n"), normal)
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, enough_docs: int = ENOUGH_DOCS) -> DataFrame:
    """(host, line) above both limits, from one pass over all lines."""
    slim = pick(docs, source="source", text="text").where("text is not null")
    marks = F.array_distinct(line_hashes(F.col("text")))
    # a null line stands for the document itself: its count is the host's size
    seen = slim.select(
        host_key(F.col("source")).alias("host"),
        F.xxhash64("text").alias("content"),
        F.explode(F.concat(F.array(F.lit(None).cast("bigint")), marks)).alias("line"),
    )
    n = seen.groupBy("host", "line").agg(F.count_distinct("content").alias("n")).where((F.col("n") > max_docs) | F.isnull("line"))
    n = cut(n)
    sizes = n.where("line is null").select("host", F.col("n").alias("size"))
    return n.where("line is not null").join(sizes, "host").where(F.col("n") > F.least(max_share * F.col("size"), F.lit(float(enough_docs)))).select("host", "line")


def _with_marks(work: DataFrame, where: dict[str, str], bad: DataFrame, limit: int) -> DataFrame:
    """Column _bad: the frequent lines to look for in the row."""
    host = host_key(F.col(where["source"]).cast("string"))
    by_host = cut(bad.groupBy("host").agg(F.collect_set("line").alias("_bad")))
    hosts, lines = by_host.agg(F.count("*"), F.coalesce(F.sum(F.size("_bad")), F.lit(0))).first()
    if fits(hosts * 32 + lines * 8, 1, limit):
        return work.withColumn("_host", host).join(F.broadcast(by_host.withColumnRenamed("host", "_host")), "_host", "left")
    # too many hosts to send: decide by content, with hashes alone in the first shuffle
    text = F.col(where["text"]).cast("string")
    content = work.select(F.xxhash64(host, text).alias("_content"), host.alias("host"), F.explode(F.array_distinct(line_hashes(text))).alias("line"))
    found = content.join(bad, ["host", "line"]).groupBy("_content").agg(F.collect_set("line").alias("_bad"))
    return work.withColumn("_content", F.xxhash64(host, text)).join(found, "_content", "left")


def line_frequency_filter(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_keep: float = MIN_KEEP, broadcast_bytes: int = BROADCAST_BYTES, enough_docs: int = ENOUGH_DOCS
) -> DataFrame:
    """The kept documents with all their columns, text without frequent lines, and ``_removed`` lines."""
    bad = frequent_lines(docs, max_docs, max_share, enough_docs)
    work, where = hide(docs)
    text = F.col(where["text"]).cast("string")
    marked = _with_marks(work, where, bad, broadcast_bytes)
    parts = F.transform(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), normal(x).alias("norm"))), lambda p: F.struct(
        p["raw"].alias("raw"), F.length(p["norm"]).alias("chars"), ((p["norm"] != "") & F.coalesce(F.array_contains("_bad", F.xxhash64(p["norm"])), F.lit(False))).alias("out")))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, p: s + p["chars"])
    judged = marked.withColumn("_parts", parts).withColumn("_kept", F.filter("_parts", lambda p: ~p["out"]))
    judged = judged.withColumn("_removed", F.size("_parts") - F.size("_kept"))
    whole, left = chars(F.col("_parts")), chars(F.col("_kept"))
    kept = judged.where((left > 0) & (left >= min_keep * whole))
    new = F.when(F.col("_removed") == 0, text).otherwise(F.array_join(F.transform("_kept", lambda p: p["raw"]), "\n"))
    out = []
    for i, name in enumerate(docs.columns):
        c = F.col(f"_c{i}")
        if f"_c{i}" == where["text"]:
            c = new
        elif name == "n_chars":
            c = F.when(F.col("_removed") == 0, c).otherwise(F.length(new)).cast(docs.schema[i].dataType)
        out.append(c.alias(f"_c{i}"))
    return kept.select(*out, "_removed")
