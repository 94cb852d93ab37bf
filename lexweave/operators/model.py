"""A model as tables: kept as Parquet, compared table by table."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KEPT, Config

VERSION = "1"
WEIGHTS = "model string, name string, class int, w smallint"
LABELS = "model string, class int, label string"
UNITS = "model string, unit double"
VOCAB = "word string, in_dict int, level int, tag string, tag_index int, tag_in_dict int"
SUBWORDS = "subword string, level int, tag string, logp double"
LM = "level int, n int, ngram string, logp double, logbackoff double"
TABLES = {"weights": WEIGHTS, "labels": LABELS, "units": UNITS, "vocab": VOCAB, "subwords": SUBWORDS, "lm": LM}
#: Names the folder of the model that is used if none is given.
DEFAULT = "LEXWEAVE_MODEL"


@dataclass
class Model:
    config: Config
    levels: int
    weights: DataFrame
    labels: DataFrame
    units: DataFrame
    vocab: DataFrame
    subwords: DataFrame
    lm: DataFrame

    def save(self, path: str) -> None:
        spark = self.weights.sparkSession
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        kept = {k: v for k, v in asdict(self.config).items() if k in KEPT}
        spark.createDataFrame([(VERSION, self.levels, json.dumps(kept))], "format_version string, levels int, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None, **changes) -> Model:
        path = path or os.environ.get(DEFAULT)
        if not path:
            raise ValueError(f"no model: give its path or set {DEFAULT}")
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["format_version"] != VERSION:
            raise ValueError(f"model format {meta['format_version']} isn't {VERSION}")
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(meta["config"]).items()}
        return cls(Config(**(kept | changes)), meta["levels"], **{t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()})

    def differences(self, other: Model) -> dict[str, int]:
        """How many rows of each table only one of the models has."""
        out = {}
        for t in TABLES:
            a, b = (getattr(m, t).select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in getattr(m, t).dtypes]) for m in (self, other))
            out[t] = a.exceptAll(b).count() + b.exceptAll(a).count()
        return out

    def explain(self, model: str = "ws") -> DataFrame:
        """The features of a model, those that weigh most first."""
        total = self.weights.where(F.col("model") == model).groupBy("name").agg(F.sum(F.abs(F.col("w").cast("bigint"))).alias("total"), F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("weights"))
        return total.orderBy(F.desc("total"), "name")


def write_rows(rows: DataFrame, path: str) -> None:
    """Training rows to be used again, a folder a model."""
    rows.withColumn("part", F.element_at(F.split("model", ":"), 1)).write.partitionBy("part").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("model", "seen", "label", "features")
