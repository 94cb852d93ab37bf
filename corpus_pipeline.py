"""A corpus from raw documents to packed windows: each stage is one operator of ``lexweave.llm``.

``run`` applies the stages to the documents table; each stage's result is
written as Parquet in the shared folder and read again as the next one's input,
and removed when the stage after it has been written.

Every stage but the last returns the columns of its input, in their order and
types, whatever else they are called; an empty table passes all of them. Ties and
repeated rows, nulls and very long texts have the results that the operators'
docstrings give; what each stage lets pass is said at it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import linededup, neardup, packing, quality, secrets
from lexweave.operators.storage import folder, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines of a host go, and documents depleted by that; null, empty and blank texts are depleted. Null hosts are one host, null ids are kept."""
    return quality.line_frequency_filter(docs).select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing is left by that; null, empty and blank texts stay as they are. Rows with equal id and text fare alike."""
    at = f"_c{docs.columns.index('text')}"
    left = linededup.dedup_lines(docs).where((F.col("_removed") == 0) | (F.trim(at) != ""))
    return left.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least id, null last. Null, empty and word-free texts stay."""
    return neardup.drop_near(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no row goes. Null stays null, empty stays empty."""
    return secrets.redact_secrets(docs).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in which window, in encoder tokens; null and empty texts have none."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]
#: Connected components, compression and sequential packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
