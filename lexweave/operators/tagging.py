"""Evidence for a word's tags as native columns: what stands around it, the word itself, and its dictionary entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, type_string
from ..sources.arrays import points, whole
from . import ngrams
from .ngrams import type_codes

WINDOW = 3
ORDER = 3


def tagged_words(sentences: DataFrame) -> DataFrame:
    """A row a word of sentences with ``words`` (surfaces): i, word (its normal form), start, size, norm and types of the sentence."""
    whole = sentences.where(F.size("words") > 0).withColumn("norm", normalize(F.array_join("words", "")))
    starts = F.concat(F.array(F.lit(0)), F.transform(ngrams.inner_ends(F.col("words")), lambda b: b + 1))
    whole = whole.withColumn("types", type_string(F.col("norm"))).withColumn("_at", F.arrays_zip(F.col("words").alias("w"), starts.alias("start")))
    rest = [c for c in sentences.columns if c != "words"]
    each = whole.select(*rest, "norm", "types", F.posexplode("_at").alias("i", "_x"))
    return each.select(*rest, "i", normalize(F.col("_x.w")).alias("word"), F.col("_x.start").alias("start"), F.length("_x.w").alias("size"), "norm", "types")


def context(seq: str, prefix: str, window: int = WINDOW, order: int = ORDER) -> Column:
    """N-grams of the characters of ``seq`` around the word from ``start``, itself skipped, with their offsets."""
    first = F.greatest(F.col("start") - window, F.lit(0))
    before = F.col("start") - first
    around = F.concat(F.substr(seq, first + 1, before), F.substr(F.col(seq), F.col("start") + F.col("size") + 1, F.lit(window)))

    def grams(text: Column) -> Column:
        one = lambda j: F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.length(text) - j)), lambda n: F.concat(F.lit(prefix), (1 - before + j).cast("string"), F.substr(text, j + 1, n)))
        return F.when(F.length(text) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(around), grams), F.lit(0))


def slim(words: DataFrame, window: int = WINDOW) -> DataFrame:
    """The words with what stands around them in place of their sentence: norm, types, start and size are such that ``context`` says the same; own_types."""
    first = F.greatest(F.col("start") - window, F.lit(0))
    near = lambda c: F.concat(F.substr(c, first + 1, F.col("start") - first), F.substr(F.col(c), F.col("start") + F.col("size") + 1, F.lit(window)))
    rest = [c for c in words.columns if c not in ("norm", "types", "start", "size")]
    own = F.substr(F.col("types"), F.col("start") + 1, F.col("size")).alias("own_types")
    return words.select(*rest, near("norm").alias("norm"), near("types").alias("types"), (F.col("start") - first).alias("start"), F.lit(0).alias("size"), own)


def local_counts(words: DataFrame, window: int = WINDOW, order: int = ORDER) -> DataFrame:
    """(word, n, correct): of each ambiguous word a model of what stands around it, weighed by counts, and how often it is right.

    ``words`` (of ``slim``): word, tag, norm, start. Equal surroundings are counted
    before they are sent; a word's different ones are in one task, 80 bytes each.
    """
    amb = words.groupBy("word").agg(F.min("tag").alias("_a"), F.max("tag").alias("_z"), F.count("*").alias("_m")).where("_a < _z").select("word", "_m")
    parts = int((amb.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0] >> 18) + 1)
    # a frequent word is a part of its own, others share one
    alone = F.when(F.col("_m") > 1 << 18, F.col("word")).alias("_alone")
    rows = words.groupBy("word", "tag", "start", "norm").agg(F.count("*").alias("m")).join(amb, "word")
    rows = rows.select("word", "tag", "start", "norm", "m", alone, F.pmod(F.xxhash64("word"), F.lit(parts)).alias("_part"))

    def model(own: pa.Table) -> pa.Table:
        flat, bounds = points(whole(own.column("norm")))
        tags = whole(own.column("tag"))
        classes = sorted(x for x in set(tags.to_pylist()) if x is not None)
        label = pc.fill_null(pc.index_in(tags, value_set=pa.array(classes, pa.string())), -1).to_numpy(zero_copy_only=False)
        coded = whole(own.column("word")).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mine = np.zeros((len(coded.dictionary), len(classes)), bool)
        mine[word[label >= 0], label[label >= 0]] = True
        many, start = whole(own.column("m")).to_numpy(), whole(own.column("start")).to_numpy()
        row = np.repeat(np.arange(len(many)), np.diff(bounds))
        place = np.arange(len(flat)) - bounds[:-1][row] + window - start[row]
        around = np.zeros((len(many), 2 * window), np.int64)
        around[row, place] = flat.astype(np.int64) + 1
        kinds = np.where(around > 0, type_codes(np.maximum(around - 1, 0).astype(np.uint32)).astype(np.int64) + 1, 0)
        scores, seen = np.zeros((len(many), len(classes)), np.int64), np.zeros(len(many), bool)
        for seq in (around, kinds):
            for n in range(1, order + 1):
                for c in range(2 * window - n + 1):
                    at = np.flatnonzero((seq[:, c : c + n] > 0).all(1))
                    if not len(at):
                        continue
                    seen[at] = True
                    code = np.zeros(len(at), np.int64)
                    for k in range(n):
                        if k % 2 == 0 and k:
                            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
                        code = code << 21 | seq[at, c + k]
                    back = np.unique(code, return_inverse=True)[1].astype(np.int64)
                    back = np.unique(back * len(mine) + word[at], return_inverse=True)[1]
                    told = label[at] >= 0
                    count = np.zeros((back.max() + 1, len(classes)), np.int64)
                    np.add.at(count, (back[told], label[at][told]), many[at][told])
                    every = count.sum(1, keepdims=True)
                    top = 1000 * (2 * count - every)
                    scores[at] += (np.sign(top) * (np.abs(top) // (every + 4)))[back]
        best = np.argmax(np.where(mine[word], scores, np.iinfo(np.int64).min), 1)  # the first of equal ones
        n = np.zeros((2, len(mine)), np.int64)
        np.add.at(n[0], word[seen], many[seen])
        right = seen & (best == label)
        np.add.at(n[1], word[right], many[right])
        some = np.flatnonzero(n[0] > 0)
        return pa.table({"word": coded.dictionary.take(pa.array(some)), "n": pa.array(n[0][some]), "correct": pa.array(n[1][some])})

    return rows.groupBy("_part", "_alone").applyInArrow(model, "word string, n bigint, correct bigint")


def self_names(own_types: Column | None = None) -> Column:
    """The word and its types."""
    own = F.substr(F.col("types"), F.col("start") + 1, F.col("size")) if own_types is None else own_types
    return F.array(F.concat(F.lit("SX"), "word"), F.concat(F.lit("ST"), own))


def dictionary_names(entries: DataFrame) -> DataFrame:
    """(word, names): ``D{dictionary}T{tag}`` of each tag that a dictionary offers for the word, UNK if none does.

    ``entries``: word, tag_index, tag_in_dict (mask of dictionaries).
    """
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda d: F.getbit(F.col("tag_in_dict"), d) == 1)
    rows = entries.select("word", F.explode_outer(F.transform(bits, lambda d: F.concat(F.lit("D"), d.cast("string"), F.lit("T"), F.col("tag_index").cast("string")))).alias("name"))
    names = rows.groupBy("word").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("word", F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("UNK"))).alias("names"))
