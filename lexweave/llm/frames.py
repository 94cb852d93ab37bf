"""Column picking, keys, checkpoints and size-checked broadcasts shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import keep

#: Largest table, in bytes, that an operator sends to every executor.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under new names and as the given types.

    ``pick(docs, id="doc_id:bigint")``. Columns are found by exact name and
    position, so that extra columns, whatever their names or case, can't clash.
    """
    where = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for new, spec in columns.items():
        old, _, kind = spec.partition(":")
        out.append(F.col(f"_{where[old]}").cast(kind or "string").alias(new))
    return plain.select(*out)


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns renamed ``_c0``, ``_c1`` ..., and where each name went."""
    where = {name: f"_c{i}" for i, name in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), where


def unhide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[f"_c{i}" for i in range(len(columns))]).toDF(*columns)


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a document: rows with equal id and text are the same document."""
    return F.xxhash64(doc_id, text, F.isnull(doc_id), F.isnull(text))


def cut(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder: survives lost executors."""
    return keep(df)


def fits(rows: int, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_a_row <= limit


def maybe_broadcast(df: DataFrame, rows: int, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast the frame if its counted size allows; else leave the join to a shuffle."""
    return F.broadcast(df) if fits(rows, bytes_a_row, limit) else df
