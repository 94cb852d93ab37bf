"""Vocabularies, label sets and feature numbers in the order of first sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .storage import keep


def number_rows(df: DataFrame, order: list[Column], name: str = "id", start: int = 1) -> DataFrame:
    """The frame with dense numbers in a global order; no row passes through a single task.

    Sorted range partitions number their own rows; the partitions' sizes, one
    row each, give where each begins.
    """
    # the bounds of the ranges are sampled anew at each run: the sorted rows are kept, so that sizes and numbers are of the same partitions
    parts = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in parts.groupBy(part.alias("_part")).agg(F.count("*")).collect())
    base, total = [], start
    for p, n in sizes:
        base.append((p, total))
        total += n
    offset = df.sparkSession.createDataFrame(base, "_part bigint, _base bigint")
    rows = parts.withColumn("_part", part).join(F.broadcast(offset), "_part")  # one row a partition
    return rows.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")


def vocabulary(tokens: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(word, in_dict, tags): normalised words with their distinct tags, first seen first.

    ``tokens`` has word, tag (may be null) and seen, an orderable place;
    ``entries``, (word, in_dict), adds dictionary words without tags of their own.
    """
    rows = tokens.select(normalize(F.col("word")).alias("word"), "tag", "seen")
    once = rows.groupBy("word", "tag").agg(F.min("seen").alias("seen"))
    words = once.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.isnotnull("tag"), F.struct("seen", "tag")))).alias("tags"))
    words = words.select("word", F.transform("tags", lambda t: t["tag"]).alias("tags"))
    if entries is None:
        return words.select("word", F.lit(0).alias("in_dict"), "tags")
    both = words.join(entries, "word", "full_outer")
    return both.select("word", F.coalesce("in_dict", F.lit(0)).alias("in_dict"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def ambiguous(vocab: DataFrame) -> DataFrame:
    """The words that need a model of their own."""
    return vocab.where(F.size("tags") > 1)


def label_set(tokens: DataFrame) -> DataFrame:
    """(tag, label): distinct tags, numbered from 1 as first seen."""
    return number_rows(tokens.where("tag is not null").groupBy("tag").agg(F.min("seen").alias("seen"), F.count("*").alias("n")), [F.col("seen")], "label").drop("seen")


def feature_numbers(names: DataFrame) -> DataFrame:
    """(name, fid) of (name, seen), numbered from 1 as first seen."""
    return number_rows(names.groupBy("name").agg(F.min("seen").alias("seen")), [F.col("seen")], "fid").select("name", "fid")


def levels(words: DataFrame) -> int:
    """The most tag levels that a certain word has."""
    return words.where("is_certain").agg(F.coalesce(F.max(F.size("tags")), F.lit(0))).first()[0]
