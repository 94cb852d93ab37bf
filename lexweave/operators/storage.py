"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that all machines share; one of our own only where there is a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame) -> DataFrame:
    """The frame computed once and written to the shared folder: survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Largest table of a model, in bytes, that is sent through the driver to the tasks.
SENT_BYTES = 512 << 20


def limited(df: DataFrame, text: str, most: int = SENT_BYTES) -> DataFrame:
    """The frame, if it is small enough to be sent whole; else an error that says so before anything is collected."""
    n = df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    if n > most:
        raise ValueError(f"a table of {n} bytes is too large to be sent to every task: {', '.join(df.columns)}")
    return df
