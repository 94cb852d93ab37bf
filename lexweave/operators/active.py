"""Active learning: what to annotate next, and merging annotations back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import chars, escape


def split_chars(line: Column) -> Column:
    """A line as a corpus without annotation: a blank between each two characters."""
    return F.array_join(F.transform(chars(line), lambda c: escape(c, " -&|\\?")), " ")


def uncertain_points(points: DataFrame, k: int = 100) -> DataFrame:
    """The k least certain points, no two with the same pair of characters around them.

    ``points``: row, b (place), conf, pair. Result: rank, row, b, conf, pair.
    """
    order = [F.abs("conf"), F.col("row"), F.col("b")]
    best = points.withColumn("_r", F.row_number().over(W.partitionBy("pair").orderBy(*order))).where("_r = 1").drop("_r")
    top = best.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # k rows


def mark_points(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, line): the partial line of each chosen point's row with ``!`` at the point.

    ``lines``: row, line, a character and a mark in turn, without escapes or tags.
    """
    return lines.join(F.broadcast(chosen.select("row", "b", "rank")), "row").select("rank", "row", "b", F.overlay("line", F.lit("!"), 2 * F.col("b") + 2, F.lit(1)).alias("line"))  # k rows


def mark_words(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """As mark_points, with the predicted marks filled in on both sides up to the nearest predicted breaks.

    ``lines`` also has breaks, the places after which a word is predicted to end.
    """
    both = lines.join(F.broadcast(chosen.select("row", "b", "rank")), "row")  # k rows
    left = F.coalesce(F.array_max(F.filter("breaks", lambda x: x < F.col("b"))), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter("breaks", lambda x: x > F.col("b"))), F.length("surface") - 1)
    mark = lambda c, i: F.when(i == F.length("surface") - 1, "").when(i == F.col("b"), "!").when((i < left) | (i > right), " ").when(F.array_contains("breaks", i), "|").otherwise("-")
    return both.select("rank", "row", "b", F.array_join(F.transform(chars(F.col("surface")), lambda c, i: F.concat(c, mark(c, i))), "").alias("line"))


_VALID = r"^(?:(?:\\.|[^\\])[-| ?])*(?:\\.|[^\\])$"


def merge_annotations(corpus: DataFrame, annotated: DataFrame) -> DataFrame:
    """(row, line): the corpus with annotated lines in place of its own; an annotation with an open point or a missing mark is an error."""
    bad = ~F.col("new").rlike(_VALID) & (F.col("new") != "")  # an open point is no mark
    new = F.when(bad, F.raise_error(F.concat(F.lit("not a finished annotation: "), "new"))).otherwise(F.col("new"))
    both = corpus.join(annotated.select("row", F.col("line").alias("new")), "row", "left")
    return both.select("row", F.coalesce(F.when(F.isnotnull("new"), new), "line").alias("line"))
