"""Training: annotated sentences to the tables of a model."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import features, solvers
from ..functions.text import type_text
from . import matching, subwords
from .model import LABELS, LM, SUBWORDS, UNITS, VOCAB, WEIGHTS, Model
from .storage import keep, limited

#: (model, seen, label, features): a training row; ``seen`` orders labels and features.
ROWS = "model string, seen string, label string, features array<string>"


def useful(sentences: DataFrame) -> DataFrame:
    """Those with a certain word or something known of a boundary."""
    return sentences.where(F.exists("words", lambda w: w["is_certain"]) | F.exists("ws_confs", lambda c: c != 0))


def order_key(*columns: str) -> F.Column:
    """A string that sorts like these columns of whole numbers."""
    return F.concat_ws(":", *[F.lpad(F.col(c).cast("string"), 19, "0") for c in columns])


def tokens(sentences: DataFrame) -> DataFrame:
    """(word, level, tag, seen) of the certain words; level and tag are null for a word without tags."""
    word = sentences.select("seen", F.posexplode("words").alias("i", "w")).where("w.is_certain")
    level = word.select("seen", "i", F.col("w.norm").alias("word"), F.posexplode_outer(F.transform("w.tags", lambda t: F.get(t, F.lit(0))["tag"])).alias("level", "tag"))
    return level.select("word", F.when(F.isnotnull("tag"), F.col("level")).alias("level"), "tag", F.concat_ws(":", "seen", F.lpad(F.col("i").cast("string"), 9, "0")).alias("seen"))


def entries_of(dictionaries: list[DataFrame], numbered: bool = True) -> DataFrame | None:
    """(word, level, tag, bit, seen) of parsed dictionaries, one word a line; anything else is an error."""
    if len(dictionaries) > matching.MAX_DICTIONARIES and numbered:
        raise ValueError(f"at most {matching.MAX_DICTIONARIES} dictionaries are possible")
    out = None
    for d, df in enumerate(dictionaries):
        word = F.when(F.size("words") == 1, F.get("words", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("a dictionary line holds one word: "), "surface")))
        rows = df.where(F.size("words") > 0).select(word["norm"].alias("word"), F.posexplode_outer(word["tags"]).alias("level", "t"), F.monotonically_increasing_id().alias("n"))
        rows = rows.select("word", "level", F.posexplode_outer(F.transform("t", lambda t: t["tag"])).alias("k", "tag"), "n")
        rows = rows.select("word", F.when(F.isnotnull("tag"), F.col("level")).alias("level"), "tag", F.lit(1 << d).alias("bit"), F.concat_ws(":", F.lit("~"), F.lpad(F.lit(str(d)), 3, "0"), F.lpad(F.col("n").cast("string"), 19, "0"), F.lpad(F.coalesce("k", F.lit(0)).cast("string"), 5, "0")).alias("seen"))
        out = rows if out is None else out.unionByName(rows)
    return out


def vocabulary(sentences: DataFrame, dictionaries: DataFrame | None) -> DataFrame:
    """(word, in_dict, level, tag, tag_index, tag_in_dict): corpus words first, then the dictionaries' own."""
    rows = tokens(sentences).withColumn("bit", F.lit(0))
    if dictionaries is not None:
        rows = rows.unionByName(dictionaries)
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("in_dict"))
    tags = rows.where("tag is not null").groupBy("word", "level", "tag").agg(F.min("seen").alias("seen"), F.bit_or("bit").alias("tag_in_dict"))
    tags = tags.withColumn("tag_index", F.expr("cast(row_number() over (partition by word, level order by seen, tag) - 1 as int)")).drop("seen")
    return words.join(tags, "word", "left").select("word", "in_dict", "level", "tag", "tag_index", "tag_in_dict")


class Lexicon:
    """The vocabulary in a task."""

    def __init__(self, rows: list[tuple]) -> None:
        self.mask: dict[str, int] = {}
        self.tags: dict[tuple[str, int], list[tuple[int, str, int]]] = defaultdict(list)
        for word, in_dict, level, tag, index, tag_mask in rows:
            self.mask[word] = in_dict
            if tag is not None:
                self.tags[word, level].append((index, tag, tag_mask))
        for own in self.tags.values():
            own.sort()
        self.find = matching.automaton({w: m for w, m in self.mask.items() if m})

    def matches(self, norm: str) -> list[tuple[int, int, int]]:
        return [(e, len(w), m) for e, (w, m) in self.find.iter(norm)] if len(self.find) else []

    def entry(self, word: str, level: int) -> list[tuple[int, int]] | None:
        own = self.tags.get((word, level))
        return own and [(i, m) for i, _, m in own]


def training_rows(sentences: DataFrame, vocab: DataFrame, config: Config, levels: int) -> DataFrame:
    limited(vocab, "word")
    held = sentences.sparkSession.sparkContext.broadcast([tuple(r.values()) for r in vocab.select("word", "in_dict", "level", "tag", "tag_index", "tag_in_dict").toArrow().to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(held.value)
        for b in batches:
            out: list[tuple[str, str, str, list[str]]] = []
            for s in b.to_pylist():
                norm, types = s["norm"], type_text(s["norm"])
                if config.segment and len(norm) > 1:
                    rows = features.sentence_boundary_features(norm, types, lexicon.matches(norm), config)
                    out += [("ws", f"{s['seen']}:{i:09d}", "1" if c > 0 else "-1", row) for i, (c, row) in enumerate(zip(s["ws_confs"], rows)) if abs(c) > config.confidence]
                at = 0
                for k, w in enumerate(s["words"]):
                    start, at = at, at + len(w["surface"])
                    for lev, cands in enumerate(w["tags"][:levels] if config.tag and w["is_certain"] else ()):
                        if not cands or cands[0]["score"] <= config.confidence or lev in config.skip_levels:
                            continue
                        wide, own = lev in config.global_levels, lexicon.tags.get((w["norm"], lev), ())
                        if not wide and len(own) < 2:
                            continue
                        row = features.context_features(norm, types, start, at, config)
                        if wide:
                            row += features.self_features(w["norm"], types[start:at]) + features.tag_dictionary_features(lexicon.entry(w["norm"], lev))
                        out.append((f"global:{lev}" if wide else f"local:{lev}:{w['norm']}", f"{s['seen']}:{k:09d}", cands[0]["tag"], row))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.string()))], ["model", "seen", "label", "features"])

    return sentences.select("seen", "norm", "ws_confs", "words").mapInArrow(run, ROWS)


FITTED = "model string, kind string, name string, class int, w smallint, unit double"


def _fit(config: Config):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seen")
        model, ids, names = key[0].as_py(), {}, {}
        labels = [ids.setdefault(x, len(ids)) for x in table.column("label").to_pylist()]
        rows = [[names.setdefault(f, len(names)) for f in own] for own in table.column("features").to_pylist()]
        w = solvers.train(rows, labels, len(names), len(ids), config.solver, config.cost, config.eps, config.bias)
        if model == "ws" and next(iter(ids)) == "-1":
            w = -w
        if model == "ws" and len(ids) == 1:
            w[-1] = 1.0 if "1" in ids else -1.0  # what is always so
        small, unit = solvers.quantize(w)
        out = [(model, "label", t, i, 0, 0.0) for t, i in ids.items()] + [(model, "unit", None, 0, 0, unit)]
        if len(ids) > 1 or model == "ws":
            # the bias is the feature without a name
            out += [(model, "w", n, c, int(small[i, c]), 0.0) for n, i in [*names.items(), ("", len(names))] for c in range(small.shape[1]) if small[i, c]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int16(), pa.float64()]
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(("model", "kind", "name", "class", "w", "unit"), kinds))})

    return run


def fit(rows: DataFrame, config: Config) -> DataFrame:
    """Weights, labels and multipliers of each model; models are fitted beside each other."""
    return rows.groupBy("model").applyInArrow(_fit(config), FITTED)


#: Features of a segmentation model that is fitted over all partitions; the most frequent ones where there are more.
SPREAD_FEATURES = 1 << 20


def fit_spread(rows: DataFrame, config: Config) -> DataFrame:
    """As fit, for the segmentation model: all partitions work on one optimum, whatever the number of boundaries. The bias isn't held down."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    if config.solver not in (0, 3, 6, 7):
        raise ValueError("solvers 0, 3, 6 and 7 are there over all partitions")
    own = keep(rows.where("model = 'ws'").select((F.col("label") == "1").cast("double").alias("label"), F.array_distinct("features").alias("names")))
    n, hits = own.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    spark, labels = rows.sparkSession, [("ws", "label", x, i, 0, 0.0) for i, x in enumerate(("1", "-1")) if (hits if x == "1" else n - hits) > 0]
    if not n:
        return spark.createDataFrame([], FITTED)
    if len(labels) < 2:
        return spark.createDataFrame([*labels, ("ws", "unit", None, 0, 0, 1.0), ("ws", "w", "", 0, 1 if hits else -1, 0.0)], FITTED)
    words = CountVectorizer(inputCol="names", outputCol="x", binary=True, vocabSize=SPREAD_FEATURES).fit(own)
    common = {"featuresCol": "x", "regParam": 1 / (config.cost * n), "fitIntercept": config.bias > 0, "standardization": False, "maxIter": 100, "tol": min(config.eps, 0.01) * 1e-4}
    learner = LinearSVC(**common) if config.solver == 3 else LogisticRegression(elasticNetParam=1.0 if config.solver == 6 else 0.0, **common)
    found = learner.fit(words.transform(own))
    small, unit = solvers.quantize(np.append(found.coefficients.toArray(), found.intercept / abs(config.bias))[:, None])
    kept = [("ws", "w", name, 0, int(x), 0.0) for name, x in zip([*words.vocabulary, ""], small[:, 0]) if x]
    return spark.createDataFrame([*labels, ("ws", "unit", None, 0, 0, float(unit)), *kept], FITTED)


def train_spread(sentences: DataFrame, config: Config | None = None, **options) -> Model:
    """As train, with the segmentation model fitted over all partitions."""
    return train(sentences, config, spread=True, **options)


def train(sentences: DataFrame, config: Config | None = None, dictionaries: list[DataFrame] | None = None, subword_dictionaries: list[DataFrame] | None = None, rows: DataFrame | None = None, spread: bool = False) -> Model:
    """A model of annotated sentences.

    ``sentences`` has ``seen`` (a string that orders them) beside a sentence's
    columns; ``rows`` are training rows kept from elsewhere, added to them.
    """
    config = config or Config()
    spark: SparkSession = sentences.sparkSession
    used = keep(useful(sentences))
    known = entries_of(dictionaries or [])
    vocab = keep(vocabulary(used, known).selectExpr("word", "in_dict", "level", "tag", "tag_index", "tag_in_dict"))
    if vocab.isEmpty() and rows is None:
        raise ValueError("training needs an annotated sentence, a dictionary or training rows")
    levels = vocab.agg(F.coalesce(F.max("level"), F.lit(-1)) + 1).first()[0] if config.tag else 0
    data = training_rows(used, vocab, config, levels)
    data = data if rows is None else data.unionByName(rows.select("model", "seen", "label", "features"))
    fitted = fit(data.where("model <> 'ws'"), config).unionByName(fit_spread(data, config)) if spread else fit(data, config)
    fitted = keep(fitted)
    sub, lm = spark.createDataFrame([], SUBWORDS), spark.createDataFrame([], LM)
    if subword_dictionaries:
        alone = [lev for lev in range(levels) if lev not in config.global_levels and lev not in config.skip_levels]
        sub, lm = subwords.train(vocab, entries_of(subword_dictionaries, numbered=False), alone, config)
    return Model(
        config=config, levels=levels, weights=fitted.where("kind = 'w'").select(*[c.split()[0] for c in WEIGHTS.split(", ")]),
        labels=fitted.where("kind = 'label'").select("model", "class", F.col("name").alias("label")), units=fitted.where("kind = 'unit'").select("model", F.col("unit")),
        vocab=vocab, subwords=sub, lm=lm,
    )


assert {c.split()[0] for c in VOCAB.split(", ")} == {"word", "in_dict", "level", "tag", "tag_index", "tag_in_dict"} and LABELS and UNITS
