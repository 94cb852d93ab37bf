"""Corpus lines: unsegmented surface, gold words and boundaries of whitespace-separated text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import arrays

#: White space that separates words, as a class both Java's and RE2's syntax know.
SPACE = "[ \\t\\r\\f\\x0b]+"
#: Characters of texts that are handled at once, whole texts apart.
CHARS_AT_ONCE = 1 << 21


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): one row a line; a null text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def gold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, words, surface, norm) of every line that holds a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # texts up to some size at once
            size = np.cumsum(arrays.lengths(b.column(1)))
            cuts = [0, *(np.flatnonzero(np.diff(size // CHARS_AT_ONCE)) + 1), len(size)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(arrays.gold_rows(part.column(0), part.column(1)), ["doc_id", "line_no", "words", "surface", "norm"])

    slim = docs.where(F.isnotnull(text_col)).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string("line_no int, words array<string>, surface string, norm string")])
    return slim.mapInArrow(run, schema)
