"""A symbol n-gram model with continuation counts and absolute discounts, by aggregation alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import limited

#: Stands before the first symbol; texts may not hold it.
PAD = "\x00"


def counts(texts: DataFrame, order: int = 3, column: str = "word") -> DataFrame:
    """(n, ngram, c): at the highest order occurrences, below it distinct extensions to the left.

    Equal texts count as often as they occur; the end of a text isn't counted.
    """
    pad = F.lit(PAD * (order - 1))
    whole = texts.where(F.length(column) > 0).groupBy(F.col(column).alias("t")).agg(F.count("*").alias("m"))
    padded = whole.select(F.concat(pad, "t").alias("p"), "m", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at"))
    level = padded.groupBy(F.substr("p", F.col("at"), F.lit(order)).alias("ngram")).agg(F.sum("m").alias("c"))
    out = level.select(F.lit(order).alias("n"), "ngram", "c")
    for n in range(order - 1, 0, -1):
        level = level.groupBy(F.substr("ngram", F.lit(2), F.lit(n)).alias("ngram")).agg(F.count("*").alias("c"))
        out = out.unionByName(level.select(F.lit(n).alias("n"), "ngram", "c"))
    return out


def discounts(counted: DataFrame) -> DataFrame:
    """(n, n1, n2, d): the discount of each order from how many n-grams were counted once and twice."""
    once = lambda k: F.sum((F.col("c") == k).cast("bigint"))
    sums = counted.groupBy("n").agg(once(1).alias("n1"), once(2).alias("n2"))
    return sums.withColumn("d", F.when(F.col("n1") * F.col("n2") == 0, 0.5).otherwise(F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))


def probabilities(counted: DataFrame) -> DataFrame:
    """(n, ngram, logp, logbackoff): discounted log probability of each n-gram's last symbol, and the log weight of backing off from it as a context."""
    context = F.substr("ngram", F.lit(1), F.col("n") - 1)
    rows = counted.withColumn("ctx", context).join(F.broadcast(discounts(counted).select("n", "d")), "n")  # a row an order
    totals = rows.groupBy("n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.first("d").alias("cd"))
    logp = F.log((F.col("c") - F.col("d")) / F.col("total"))
    below = totals.select((F.col("n") - 1).alias("n"), F.col("ctx").alias("ngram"), F.log(F.col("kinds") * F.col("cd") / F.col("total")).alias("logbackoff"))
    own = rows.join(totals.select("n", "ctx", "total"), ["n", "ctx"]).select("n", "ngram", logp.alias("logp"))
    return own.join(below, ["n", "ngram"], "full_outer")


def score_words(words: DataFrame, probabilities: DataFrame, order: int = 3) -> DataFrame:
    """(word, logp): the sum over a word's symbols, with back-off."""
    limited(probabilities, "ngram")
    table = probabilities.select("n", "ngram", "logp", "logbackoff").toArrow().to_pylist()
    held = words.sparkSession.sparkContext.broadcast(Model([tuple(r.values()) for r in table], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [w or "" for w in b.column(0).to_pylist()]
            padded = [PAD * (order - 1) + w for w in own]
            sums = [sum(held.value.score(p[: k + order - 1], c) for k, c in enumerate(w)) for w, p in zip(own, padded)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.float64())], ["word", "logp"])

    return words.select("word").mapInArrow(run, "word string, logp double")


class Model:
    """The model as maps, for scoring in a task."""

    def __init__(self, rows, order: int, vocabulary: int = 10_000) -> None:
        from math import log

        self.order, self.floor = order, -log(vocabulary)
        self.logp = {r[1]: r[2] for r in rows if r[2] is not None}
        self.back = {r[1]: r[3] for r in rows if r[3] is not None}

    def score(self, context: str, symbol: str) -> float:
        """Log probability of a symbol after a context of up to order - 1 symbols; '' as symbol is the end."""
        total, ctx = 0.0, context[-(self.order - 1) :] if self.order > 1 else ""
        while True:
            got = self.logp.get(ctx + symbol) if symbol else None
            if got is not None:
                return total + got
            total += self.back.get(ctx, 0.0)
            if not ctx:
                return total + self.floor
            ctx = ctx[1:]
