"""The stateless analysis of a stream of lines, and numbered dependency blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import analyze_lines
from ..operators.model import Model
from ..operators.vocabulary import number_rows
from ..sources import formats


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def analyze_stream(spark: SparkSession, path: str, model: Model, fmt: str | None = None, **changes) -> DataFrame:
    """Analysed lines of the files that arrive in a folder; no state is kept."""
    return analyze_lines(read_stream(spark, path), model, fmt, **changes)


def write_stream(sentences: DataFrame, path: str, fmt: str, checkpoint: str, once: bool = True):
    """The running query. Dependency blocks are numbered within each micro-batch."""

    def blocks(batch: DataFrame, number: int) -> None:
        rows = number_rows(batch.withColumn("_n", F.monotonically_increasing_id()), [F.col("_n")], "sent_id")
        formats.render(rows, "eda").select(F.concat("value", F.lit("\n"))).write.mode("append").text(path)

    if formats.format_name(fmt) == "eda":
        writer = sentences.writeStream.foreachBatch(blocks)
    else:
        writer = formats.render(sentences, fmt).writeStream.format("text").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
