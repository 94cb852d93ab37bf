"""Analysis: sentences segmented and tagged by a model, as a stateless map over rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.features import context_features, self_features, tag_dictionary_features
from ..functions.text import normalize_text, type_text
from ..sources import formats
from . import ngram_lm, ngrams, subwords
from .matching import boundary_features
from .model import Model
from .storage import limited
from .training import Lexicon

_NGRAM = re.compile(r"([XT])(-?[0-9]+)(.+)", re.DOTALL)
_CAND = pa.list_(pa.list_(pa.struct([("tag", pa.string()), ("score", pa.float64())])))
_WORDS = pa.list_(pa.struct([("surface", pa.string()), ("norm", pa.string()), ("tags", _CAND), ("is_certain", pa.bool_()), ("unknown", pa.bool_())]))


def spans_of(confs: list[float], length: int, threshold: float = 0.0) -> list[tuple[int, int]]:
    """(start, end) of the words that these boundaries make."""
    if not length:
        return []
    cuts = [0, *[i + 1 for i, c in enumerate(confs) if c > threshold], length]
    return list(zip(cuts, cuts[1:]))


def rebuild(words: list[dict], confs: list[float], surface: str, norm: str) -> list[dict]:
    """Words of the boundaries; one that was there with both its ends stays as it is, tags and all."""
    old, at = {}, 0
    for w in words:
        old[at, at + len(w["surface"])] = w
        at += len(w["surface"])
    new = lambda a, z: {"surface": surface[a:z], "norm": norm[a:z], "tags": [], "is_certain": True, "unknown": False}
    return [old.get((a, z)) or new(a, z) for a, z in spans_of(confs, len(surface))]


class Analyzer:
    """A model's tables in a task."""

    def __init__(self, config: Config, levels: int, tables: dict[str, list[tuple]]) -> None:
        self.config, self.levels = config, levels
        self.lexicon = Lexicon(tables["vocab"])
        self.labels: dict[str, list[str]] = {}
        for model, _, label in sorted(tables["labels"], key=lambda r: (r[0], r[1])):
            self.labels.setdefault(model, []).append(label)
        self.unit = dict(tables["units"])
        self.weights: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for model, name, c, w in tables["weights"]:
            self.weights.setdefault(model, {}).setdefault(name, []).append((c, w))
        ws = {name: own[0][1] for name, own in self.weights.pop("ws", {}).items()}
        self.knows_words = "ws" in self.unit
        window = max(config.char_window, config.type_window)
        grams: dict[tuple[str, str], np.ndarray] = {}
        for name, w in ws.items():
            if m := _NGRAM.fullmatch(name):
                grams.setdefault((m[1], m[3]), np.zeros(2 * window, np.int64))[int(m[2]) + window - 1] = w
        stacked = np.stack(list(grams.values())) if grams else np.zeros((0, 2 * window), np.int64)
        self.lookup = ngrams.Lookup([k for k, _ in grams], [g for _, g in grams], stacked, ws.get("", 0) if config.bias < 0 else round(ws.get("", 0) * config.bias))
        self.dict_weight = {n: w for n, w in ws.items() if n.startswith("D")}
        self.offers: dict[int, dict[str, list[tuple[str, float]]]] = {}
        for word, lev, tag, logp in tables["subwords"]:
            self.offers.setdefault(lev, {}).setdefault(word, []).append((tag, logp))
        rows: dict[int, list] = {}
        for lev, n, gram, logp, back in tables["lm"]:
            rows.setdefault(lev, []).append((n, gram, logp, back))
        self.lm = {lev: ngram_lm.Model(r, config.lm_order) for lev, r in rows.items()}
        self.seen_unknown: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def boundary_scores(self, sentences: list[dict]) -> list[np.ndarray]:
        """Scores of all boundaries of each sentence, in units of its multiplier."""
        flat, bounds = ngrams.codes([s["norm"] for s in sentences])
        line, room = ngrams._layout(bounds)
        total = self.lookup.score(flat, bounds, line, room) if len(flat) else flat.astype(np.int64)
        out = []
        for k, s in enumerate(sentences):
            own = total[bounds[k] : max(bounds[k], bounds[k + 1] - 1)]
            if self.dict_weight:
                for b, name in boundary_features(self.lexicon.matches(s["norm"]), len(s["norm"]), self.config.dict_cap):
                    own[b] += self.dict_weight.get(name, 0)
            out.append(own)
        return out

    def segment(self, s: dict, scores: np.ndarray) -> None:
        c = self.config
        score = scores * self.unit.get("ws", 1.0)
        if c.constrain and len(scores):
            types = type_text(s["norm"])
            same = np.array([a == b and a in c.constrain for a, b in zip(types, types[1:])])
            score = np.where(same, -100.0, score)
        confs = [new if abs(old) <= c.confidence else old for old, new in zip(s["ws_confs"], score.tolist())]
        s["words"] = rebuild(s["words"], confs, s["surface"], s["norm"])
        for w in s["words"]:
            w["unknown"] = w["norm"] not in self.lexicon.mask
        s["ws_signed"] = confs
        s["ws_confs"] = [1 / (1 + math.exp(-min(abs(x), 500.0))) for x in confs] if c.logistic else confs

    def scored(self, model: str, feats: list[str]) -> list[float]:
        weights, names = self.weights[model], self.labels[model]
        width = 1 if len(names) == 2 else len(names)
        sums = [0] * width
        for f in feats:
            for k, w in weights.get(f, ()):
                sums[k] += w
        for k, w in weights.get("", ()) if self.config.bias > 0 else ():
            sums[k] += w * self.config.bias
        unit = self.unit[model]
        return [sums[0] * unit, -sums[0] * unit] if width == 1 else [x * unit for x in sums]

    def ranked(self, model: str, feats: list[str]) -> list[dict]:
        """Tags best first; scores are margins over the second (then it has 0), or probabilities."""
        raw = sorted(zip(self.labels[model], self.scored(model, feats)), key=lambda x: (-x[1], x[0]))
        if self.config.logistic:
            e = [math.exp(x - raw[0][1]) for _, x in raw]
            values = [x / sum(e) for x in e]
        else:
            values = [x - raw[1][1] for _, x in raw]
        return [{"tag": t, "score": v} for (t, _), v in zip(raw, values)]

    def unknown(self, norm: str, level: int) -> list[dict]:
        if level not in self.lm or not self.config.unknown:
            return []
        if (norm, level) not in self.seen_unknown:
            self.seen_unknown[norm, level] = subwords.tag_unknown(norm, self.offers.get(level, {}), self.lm[level], self.config.beam, self.config.tag_max)
        return [{"tag": t, "score": x} for t, x in self.seen_unknown[norm, level]]

    def tag(self, s: dict, level: int) -> None:
        c, norm, types, at = self.config, s["norm"], type_text(s["norm"]), 0
        for w in s["words"]:
            start, at = at, at + len(w["surface"])
            tags = w["tags"] = [list(t) for t in w["tags"]] + [[] for _ in range(level + 1 - len(w["tags"]))]
            if tags[level] and abs(tags[level][0]["score"]) > c.confidence:
                continue
            w["unknown"] = w["norm"] not in self.lexicon.mask
            wide, local = f"global:{level}", f"local:{level}:{w['norm']}"
            known = self.lexicon.tags.get((w["norm"], level))
            sure = [{"tag": known[0][1], "score": 1.0 if c.logistic else 100.0}] if known else []
            if wide in self.labels:
                if wide in self.weights:
                    feats = context_features(norm, types, start, at, c) + self_features(w["norm"], types[start:at]) + tag_dictionary_features(self.lexicon.entry(w["norm"], level))
                    found = self.ranked(wide, feats)
                else:
                    found = [{"tag": self.labels[wide][0], "score": 1.0 if c.logistic else 100.0}]
            elif local in self.weights:
                found = self.ranked(local, context_features(norm, types, start, at, c))
            else:
                found = sure or self.unknown(w["norm"], level)
            if not found and c.default_tag:
                found = [{"tag": c.default_tag, "score": 0.0}]
            tags[level] = found[: c.tag_max] if c.tag_max else found

    def run(self, sentences: list[dict]) -> None:
        c = self.config
        for s in sentences:
            s["norm"] = normalize_text(s["surface"] or "")
            s["surface"], s["words"], s["ws_confs"] = s["surface"] or "", s["words"] or [], s["ws_confs"] or []
            s["ws_signed"] = s["ws_confs"]
        if c.segment and self.knows_words:
            for s, scores in zip(sentences, self.boundary_scores(sentences)):
                self.segment(s, scores)
        for s in sentences:
            for level in range(self.levels if c.tag else 0):
                if level not in c.skip_levels:
                    self.tag(s, level)


def analyze(sentences: DataFrame, model: Model, **changes) -> DataFrame:
    """The sentences with words and tags; no row is shuffled. ``changes`` are options of this run.

    Adds ``ws_signed``, the boundaries' scores with their sign (logistic models
    give probabilities of the more likely side in ``ws_confs``).
    """
    config = model.config.with_(**changes) if changes else model.config
    if config.segment and model.units.where("model = 'ws'").isEmpty():
        raise ValueError("the model can't segment: it was trained without")
    for t, text in (("vocab", "word"), ("weights", "name"), ("subwords", "subword"), ("lm", "ngram")):
        limited(getattr(model, t), text)
    tables = {t: [tuple(r.values()) for r in getattr(model, t).select(*cols).toArrow().to_pylist()] for t, cols in (
        ("vocab", ["word", "in_dict", "level", "tag", "tag_index", "tag_in_dict"]), ("labels", ["model", "class", "label"]), ("units", ["model", "unit"]),
        ("weights", ["model", "name", "class", "w"]), ("subwords", ["subword", "level", "tag", "logp"]), ("lm", ["level", "n", "ngram", "logp", "logbackoff"]))}
    held = sentences.sparkSession.sparkContext.broadcast((config, model.levels, tables))
    names = sentences.columns
    parts = {"surface": pa.string(), "norm": pa.string(), "ws_confs": pa.list_(pa.float64()), "words": _WORDS, "ws_signed": pa.list_(pa.float64())}
    rest = [n for n in names if n not in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = Analyzer(*held.value)
        for b in batches:
            own = b.select(["surface", "norm", "ws_confs", "words"]).to_pylist()
            analyzer.run(own)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], *[pa.array([s[k] for s in own], t) for k, t in parts.items()]], [*rest, *parts])

    fields = ", ".join(["surface string", "norm string", "ws_confs array<double>", f"words array<{formats.WORD}>", "ws_signed array<double>"])
    schema = T.StructType([*sentences.select(*rest).schema, *sentences.sparkSession.createDataFrame([], fields).schema])
    return sentences.mapInArrow(run, schema)


def analyze_lines(lines: DataFrame, model: Model, fmt: str | None = None, column: str = "value", **changes) -> DataFrame:
    """Lines of a format; without one raw if words are to be found, else tokenized. Annotated formats keep their words."""
    config = model.config.with_(**changes) if changes else model.config
    fmt = formats.format_name(fmt or ("raw" if config.segment else "tok"))
    if fmt in ("full", "tok", "tags"):
        changes["segment"] = False
    elif not config.segment and fmt == "raw":
        raise ValueError("raw text can't be read without segmentation")
    return analyze(formats.parse(lines, fmt, column), model, **changes)


def top_tags(level: int = 0) -> F.Column:
    return F.transform("words", lambda w: F.get(F.get(w["tags"], F.lit(level)), F.lit(0))["tag"])
