"""The engine's queries over the test tables and their DuckDB texts; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import active, lines, matching, ngram_lm, ngrams, vocabulary
from ..operators.storage import keep
from ..sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return f"translate({x}, {_quote(X.NARROW)}, {_quote(X.FULL)})"


_TYPE = """CASE WHEN u BETWEEN 65 AND 90 OR u BETWEEN 97 AND 122 OR u BETWEEN 65313 AND 65338 OR u BETWEEN 65345 AND 65370 THEN 'R'
 WHEN u BETWEEN 12352 AND 12438 THEN 'H' WHEN (u BETWEEN 12448 AND 12543 AND u <> 12539) OR u BETWEEN 65382 AND 65439 THEN 'T'
 WHEN u BETWEEN 48 AND 57 OR u BETWEEN 65296 AND 65305 THEN 'D'
 WHEN u BETWEEN 13312 AND 19903 OR u BETWEEN 19968 AND 40959 OR u BETWEEN 63744 AND 64255 OR u BETWEEN 131072 AND 173782 OR u BETWEEN 173824 AND 177983 OR u BETWEEN 177984 AND 178207 OR u BETWEEN 194560 AND 195103 THEN 'K' ELSE 'O' END"""


def _types(x: str) -> str:
    return f"coalesce(list_aggregate(list_transform(string_split({x}, ''), lambda c: {_TYPE.replace('u ', 'unicode(c) ')}), 'string_agg', ''), '')"


_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"
_WORDS = rf"list_filter(string_split_regex(line, '{lines.SPACE.replace(chr(92) * 2, chr(92))}'), lambda w: w <> '')"
_GOLD = f"SELECT doc_id, line_no, words, array_to_string(words, '') AS surface, {_norm(chr(97) + 'rray_to_string(words, ' + chr(39) * 2 + ')')} AS norm FROM (SELECT doc_id, line_no, {_WORDS} AS words FROM ({_LINES})) WHERE len(words) > 0"
_ESC = r"regexp_replace({}, '([ /&\\])', '\\\1', 'g')"


@query(f"SELECT {_TYPE} AS type, count(*) AS n FROM (SELECT unicode(c) AS u FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '') GROUP BY 1")
def char_types(spark, sf_dir):
    """How many characters there are of each type."""
    types = table(spark, sf_dir, "documents").where("text is not null").select(X.type_string(F.col("text")).alias("t"))
    counts = types.select(*[F.sum(F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).alias(c) for c in "KTHRDO"])
    return counts.unpivot([], list("KTHRDO"), "type", "n").where("n > 0")


@query(f"SELECT doc_id, {_types('text')} AS types FROM documents WHERE text IS NOT NULL")
def type_string(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.type_string(F.col("text")).alias("types"))


@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, line_no, array_to_string(words, '') AS surface, CAST(len(words) AS INTEGER) AS words, CAST(len(words) - 1 AS INTEGER) AS breaks FROM (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM ({_LINES})) WHERE len(words) > 0")
def tok_read(spark, sf_dir):
    """Tokenized lines as sentences."""
    out = formats.parse(lines.split_lines(table(spark, sf_dir, "documents")), "tok", "line").where(F.size("words") > 0)
    return out.select("doc_id", "line_no", "surface", F.size("words").alias("words"), F.size(F.filter("ws_confs", lambda c: c > 0)).alias("breaks"))


def _annotated(spark, sf_dir):
    """Lines annotated with two levels: the length of each word, and the word itself."""
    gold = lines.gold(table(spark, sf_dir, "documents"))
    word = lambda w: F.concat_ws("/", X.escape(w), F.concat(F.lit("L"), F.length(w).cast("string")), X.escape(w))  # noqa: E731
    return gold.select("doc_id", "line_no", F.array_join(F.transform("words", word), " ").alias("line"))


@query(f"SELECT doc_id, line_no, array_to_string(list_transform(words, lambda w: {_ESC.format('w')} || '/L' || length(w) || '/' || {_ESC.format('w')}), ' ') AS line, surface, CAST(len(words) AS INTEGER) AS words FROM ({_GOLD})")
def full_read_write(spark, sf_dir):
    """Annotated lines, escapes and all, read and written again."""
    out = formats.parse(_annotated(spark, sf_dir), "full", "line")
    return out.select("doc_id", "line_no", formats.write_full(formats.sentence()).alias("line"), "surface", F.size("words").alias("words"))


@query(f"SELECT doc_id, line_no, array_to_string(list_transform(words, lambda w: 'L' || length(w) || '/' || {_ESC.format('w')}), ' ') AS line FROM ({_GOLD})")
def tags_write(spark, sf_dir):
    out = formats.parse(_annotated(spark, sf_dir), "full", "line")
    return out.select("doc_id", "line_no", formats.write_tags(formats.sentence()).alias("line"))


@query(f"SELECT doc_id, line_no, array_to_string(list_transform(words, lambda w: array_to_string(list_filter(string_split(w, ''), lambda c: c <> ''), '-')), '|') AS line FROM ({_GOLD})")
def part_write(spark, sf_dir):
    out = formats.parse(lines.gold(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.array_join("words", " ").alias("line")), "tok", "line")
    return out.select("doc_id", "line_no", formats.write_partial(formats.sentence()).alias("line"))


@query(f"SELECT doc_id, line_no, surface, CAST(len(words) AS INTEGER) AS words, CAST(len(words) AS INTEGER) AS certain, CAST(len(words) - 1 AS INTEGER) AS breaks FROM ({_GOLD})")
def part_read(spark, sf_dir):
    """Partially annotated lines (here with a mark at each place) as sentences."""
    gold = lines.gold(table(spark, sf_dir, "documents"))
    marked = gold.select("doc_id", "line_no", formats.marked(F.col("words"), "|", "-").alias("line"))
    out = formats.parse(marked, "part", "line")
    return out.select("doc_id", "line_no", "surface", F.size("words").alias("words"), F.size(F.filter("words", lambda w: w["is_certain"])).alias("certain"), F.size(F.filter("ws_confs", lambda c: c > 0)).alias("breaks"))


@query(f"SELECT doc_id, line_no, array_to_string(words, ' ') || chr(10) || array_to_string(list_transform(range(length(surface) - 1), lambda i: '100'), ' ') AS block FROM (SELECT doc_id, line_no, list_transform(words, lambda w: {_ESC.format('w')}) AS words, surface FROM ({_GOLD}))")
def conf_write(spark, sf_dir):
    out = formats.parse(lines.gold(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.array_join("words", " ").alias("line")), "tok", "line")
    return out.select("doc_id", "line_no", formats.write_confident(formats.sentence()).alias("block"))


@query(f"SELECT doc_id, line_no, len(words) - 1 AS breaks, length(surface) - len(words) AS inner_places FROM ({_GOLD})")
def conf_read(spark, sf_dir):
    out = formats.parse(conf_write(spark, sf_dir), "conf", "block")
    many = lambda p: F.size(F.filter("ws_confs", p)).cast("bigint")  # noqa: E731
    return out.select("doc_id", "line_no", many(lambda c: c > 0).alias("breaks"), many(lambda c: c < 0).alias("inner_places"))


@query(f"SELECT doc_id, line_no, 'ID=' || row_number() OVER (PARTITION BY doc_id ORDER BY line_no) || chr(10) || array_to_string(list_transform(words, lambda w, i: CAST(i AS VARCHAR) || ' ' || CAST(i + 1 AS VARCHAR) || ' ' || w || ' UNK 0'), chr(10)) AS block FROM ({_GOLD})")
def eda_write(spark, sf_dir):
    """Dependency blocks, numbered within their document."""
    out = formats.parse(lines.gold(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.array_join("words", " ").alias("line")), "tok", "line")
    number = F.expr("row_number() over (partition by doc_id order by line_no)")
    out = out.select("doc_id", "line_no", formats.dependency_rows(formats.sentence()).alias("rows")).withColumn("number", number)
    return out.select("doc_id", "line_no", formats.dependency_block(F.col("rows"), F.col("number")).alias("block"))


@query(rf"SELECT doc_id, line_no, array_to_string(list_transform(list_filter(string_split(surface, ''), lambda c: c <> ''), lambda c: regexp_replace(c, '([ \-&|\\?])', '\\\1')), ' ') AS line FROM ({_GOLD})")
def split_chars(spark, sf_dir):
    """Lines as corpora without annotation."""
    return lines.gold(table(spark, sf_dir, "documents")).select("doc_id", "line_no", active.split_chars(F.col("surface")).alias("line"))


# n-gram evidence and segmentation
_W, _N = ngrams.WINDOW, ngrams.ORDER
_SEG = f"""
WITH g AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY doc_id, line_no) - size AS lo FROM (SELECT doc_id, line_no, words, surface, norm, {_types('norm')} AS types, length(norm) AS size FROM ({_GOLD}))),
ends AS (SELECT CAST(lo + sum(length(w)) OVER (PARTITION BY lo ORDER BY i) - 1 AS BIGINT) AS pos FROM (SELECT lo, unnest(words) AS w, unnest(range(len(words))) AS i FROM g)),
bounds AS MATERIALIZED (SELECT p.pos, e.pos IS NOT NULL AS brk FROM (SELECT CAST(lo + unnest(range(size - 1)) AS BIGINT) AS pos FROM g) p LEFT JOIN ends e USING (pos)),
grams AS (SELECT lo, j, n, size, substr(norm, j + 1, n) AS x, substr(types, j + 1, n) AS t FROM
 (SELECT *, unnest(range(1, least({_N}, size - j) + 1)) AS n FROM (SELECT *, unnest(range(size)) AS j FROM g))),
feats AS MATERIALIZED (SELECT CAST(lo + b AS BIGINT) AS pos, kind, CAST(j - b AS INTEGER) AS o, CASE WHEN kind = 'X' THEN x ELSE t END AS gram FROM
 (SELECT lo, j, n, x, t, size, unnest(range(j - {_W} + n - 1, j + {_W})) AS b FROM grams), (VALUES ('X'), ('T')) k(kind) WHERE b >= 0 AND b < size - 1),
evidence AS MATERIALIZED (SELECT kind, o, gram, count(*) FILTER (brk) AS pos, count(*) FILTER (NOT brk) AS neg FROM feats JOIN bounds USING (pos) GROUP BY kind, o, gram)
"""
_SCORES = """,
weights AS MATERIALIZED (SELECT kind, o, gram, CAST(1000 * (pos - neg) // (pos + neg + 4) AS INTEGER) AS w FROM evidence),
bias AS (SELECT CAST(trunc(1000 * (count(*) FILTER (brk) - count(*) FILTER (NOT brk)) / (count(*) + 4)) AS BIGINT) AS bias FROM bounds),
scores AS MATERIALIZED (SELECT pos, CAST(sum(w) AS BIGINT) + any_value(bias) AS s FROM feats JOIN weights USING (kind, o, gram), bias GROUP BY pos)
"""
_HITS = """, hits AS (SELECT lo, string_agg(CAST(CAST(pos - lo AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS breaks FROM (SELECT g.lo, s.pos FROM scores s ASOF JOIN g ON s.pos >= g.lo WHERE s.s > 0) GROUP BY lo)
"""


def _evidence(spark, sf_dir):
    gold = lines.gold(table(spark, sf_dir, "documents"))
    return gold, ngrams.count_evidence(gold)


def _long(wide: DataFrame, columns: list[str]) -> DataFrame:
    each = F.posexplode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in columns]) for k in range(2 * _W)])).alias("k", "v")
    return wide.select("kind", "gram", each).select(F.concat("kind", (F.col("k") + 1 - _W).cast("string"), "gram").alias("name"), "v.*")


@query(_SEG + "SELECT kind || CAST(o AS VARCHAR) || gram AS name, pos, neg FROM evidence")
def ws_ngrams(spark, sf_dir):
    """How often a word ends, or doesn't, under each character and type n-gram feature."""
    return _long(_evidence(spark, sf_dir)[1], ["p", "n"]).select("name", F.col("p").alias("pos"), F.col("n").alias("neg")).where("pos + neg > 0")


@query(_SEG + _SCORES + _HITS + "SELECT doc_id, line_no, surface, CAST(len(words) AS INTEGER) AS gold_words, coalesce(breaks, '') AS breaks FROM g LEFT JOIN hits USING (lo)")
def ws_segment(spark, sf_dir):
    """The flagship: weights learned from all lines, and all lines, their blanks removed, segmented by them."""
    gold, evidence = _evidence(spark, sf_dir)
    weights = keep(ngrams.associate(evidence))
    out = ngrams.score_lines(gold, weights, ngrams.break_bias(gold))
    return out.select("doc_id", "line_no", "surface", F.size("words").alias("gold_words"), F.array_join("breaks", " ").alias("breaks"))


@query(_SEG + _SCORES + ", hits AS (SELECT pos, s FROM scores WHERE s > 0) SELECT count(*) AS points, count(*) FILTER (brk) AS breaks, count(h.pos) AS predicted, count(h.pos) FILTER (brk) AS correct, CAST(sum(s) AS BIGINT) AS total FROM bounds LEFT JOIN hits h USING (pos)")
def ws_accuracy(spark, sf_dir):
    """Of the flagship's breaks, how many there are, are predicted and are right, and the sum of their scores."""
    gold, evidence = _evidence(spark, sf_dir)
    scored = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold), scores=True)
    out = scored.withColumn("own", ngrams.inner_ends(F.col("words")))
    total = lambda c: F.sum(c).cast("bigint")  # noqa: E731
    return out.agg(total(F.length("norm") - 1).alias("points"), total(F.size("own")).alias("breaks"), total(F.size("breaks")).alias("predicted"), total(F.size(F.array_intersect("own", "breaks"))).alias("correct"), total(F.aggregate("scores", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))


@query(_SEG + _SCORES + ", t AS (SELECT pos, substr(types, CAST(pos - lo AS INTEGER) + 1, 1) AS a, substr(types, CAST(pos - lo AS INTEGER) + 2, 1) AS z FROM bounds ASOF JOIN g ON bounds.pos >= g.lo) SELECT a || z AS types, count(*) AS predicted, count(*) FILTER (a = z AND a IN ('D', 'R')) AS forbidden FROM t JOIN scores USING (pos) WHERE s > 0 GROUP BY 1")
def ws_constraint(spark, sf_dir):
    """Predicted breaks by the types on both sides, and how many of them the constraint on D and R forbids."""
    gold, evidence = _evidence(spark, sf_dir)
    out = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold))
    pair = out.select(F.explode(ngrams.types_around("norm", "breaks")).alias("types"))
    return pair.groupBy("types").agg(F.count("*").alias("predicted"), F.sum(F.col("types").isin("DD", "RR").cast("bigint")).alias("forbidden"))


@query(_SEG + _SCORES + ", f AS (SELECT gram AS pair, min({'a': abs(s), 'pos': pos, 's': s}) AS m FROM feats JOIN scores USING (pos) WHERE kind = 'X' AND o = 0 AND length(gram) = 2 GROUP BY gram), t AS (SELECT pair, m.a AS a, m.pos AS pos, m.s AS conf FROM f ORDER BY a, pos LIMIT 100) SELECT CAST(row_number() OVER (ORDER BY a, pos) AS INTEGER) AS rank, doc_id, line_no, CAST(pos - lo AS INTEGER) AS b, conf, pair FROM t ASOF JOIN g ON t.pos >= g.lo")
def uncertain_points(spark, sf_dir):
    """The 100 least certain boundaries with different characters around them (a top-k report)."""
    gold, evidence = _evidence(spark, sf_dir)
    scored = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold), scores="all")
    points = ngrams.least_of_pairs(scored, ["doc_id", "line_no"]).select(F.struct("doc_id", "line_no").alias("row"), "b", "conf", "pair")
    return active.uncertain_points(points, 100).select("rank", "row.doc_id", "row.line_no", "b", "conf", "pair")


# dictionaries and vocabularies
_DICT = f"""
dict AS MATERIALIZED (SELECT word, CAST(bit_or(bit) AS INTEGER) AS in_dict FROM (SELECT {_norm('w')} AS word, 1 AS bit FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
 UNION ALL SELECT {_norm('w')}, 2 FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS w FROM benchmark)) WHERE word <> '' GROUP BY word)
"""
_TOKENS = rf"""
tok AS MATERIALIZED (SELECT {_norm('w')} AS word, role AS tag, conv_id, turn, i FROM (SELECT role, conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM
 (SELECT role, conv_id, turn, list_filter(string_split_regex(text, '[ 	

]+'), lambda w: w <> '') AS ws FROM conversations)))
"""


def _entries(spark, sf_dir):
    split = lambda t, c, s: table(spark, sf_dir, t).select(F.explode(F.split(c, s)).alias("w"))  # noqa: E731
    return matching.dictionary([split("part", "p_name", " "), split("benchmark", "text", "[ \\n]+")])


def _tokens(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    word = talk.select("role", "conv_id", "turn", F.posexplode(F.filter(F.split("text", "[ \\t\\r\\f\\x0b\\n]+"), lambda w: w != "")).alias("i", "word"))
    return word.select("word", F.col("role").alias("tag"), F.struct("conv_id", "turn", "i", "role").alias("seen"))


@query(f"WITH {_DICT}, g AS (SELECT norm FROM ({_GOLD})), m AS (SELECT max(length(word)) AS most FROM dict), parts AS (SELECT substr(norm, CAST(j AS INTEGER), CAST(n AS INTEGER)) AS word FROM (SELECT norm, j, unnest(range(1, least(most, length(norm) - j + 1) + 1)) AS n FROM (SELECT norm, unnest(range(1, length(norm) + 1)) AS j FROM g), m)) SELECT word, in_dict, count(*) AS n FROM parts JOIN dict USING (word) GROUP BY ALL")
def dict_match(spark, sf_dir):
    """Occurrences of each dictionary word as a substring of the unsegmented lines."""
    return matching.match_counts(lines.gold(table(spark, sf_dir, "documents")), _entries(spark, sf_dir))


@query()
def ws_dict_features(spark, sf_dir):
    """At how many boundaries each dictionary feature holds."""
    return matching.boundary_feature_counts(lines.gold(table(spark, sf_dir, "documents")), _entries(spark, sf_dir))


@query(f"WITH {_DICT} SELECT w AS word, count(*) AS n FROM (SELECT unnest(words) AS w FROM ({_GOLD})) WHERE NOT EXISTS (SELECT 1 FROM dict WHERE word = {_norm('w')}) GROUP BY 1")
def oov_words(spark, sf_dir):
    """Words of the lines that no dictionary holds."""
    words = lines.gold(table(spark, sf_dir, "documents")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return matching.unknown_words(words, _entries(spark, sf_dir))


@query(f"WITH {_DICT}, {_TOKENS}, t AS (SELECT word, string_agg(tag, ' ' ORDER BY f) AS tags FROM (SELECT word, tag, min((conv_id, turn, i, tag)) AS f FROM tok GROUP BY word, tag) GROUP BY word) SELECT coalesce(t.word, dict.word) AS word, coalesce(in_dict, 0) AS in_dict, coalesce(tags, '') AS tags FROM t FULL JOIN dict USING (word)")
def vocab(spark, sf_dir):
    """All words with the mask of their dictionaries and their tags, first seen first."""
    return vocabulary.vocabulary(_tokens(spark, sf_dir), _entries(spark, sf_dir)).select("word", "in_dict", F.array_join("tags", " ").alias("tags"))


@query(f"WITH {_TOKENS} SELECT word, CAST(count(DISTINCT tag) AS INTEGER) AS tags FROM tok GROUP BY word HAVING count(DISTINCT tag) > 1")
def ambiguous_words(spark, sf_dir):
    return vocabulary.ambiguous(vocabulary.vocabulary(_tokens(spark, sf_dir))).select("word", F.size("tags").alias("tags"))


@query(f"WITH {_TOKENS} SELECT tag, n, row_number() OVER (ORDER BY f) AS label FROM (SELECT tag, count(*) AS n, min((conv_id, turn, i, tag)) AS f FROM tok GROUP BY tag)")
def label_set(spark, sf_dir):
    return vocabulary.label_set(_tokens(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT 'SX' || word AS name, row_number() OVER (ORDER BY f) AS fid FROM (SELECT word, min((conv_id, turn, i, tag)) AS f FROM tok GROUP BY word)")
def feature_vocab(spark, sf_dir):
    """Features numbered as first seen."""
    return vocabulary.feature_numbers(_tokens(spark, sf_dir).select(F.concat(F.lit("SX"), X.normalize(F.col("word"))).alias("name"), "seen"))


# the model of symbol n-grams
_COUNTS = f"""{_TOKENS}, p AS (SELECT chr(1) || chr(1) || word AS p, length(word) AS l FROM tok),
c3 AS MATERIALIZED (SELECT substr(p, CAST(i AS INTEGER), 3) AS ngram, count(*) AS c FROM (SELECT p, unnest(range(1, l + 1)) AS i FROM p) GROUP BY 1),
c2 AS MATERIALIZED (SELECT substr(ngram, 2, 2) AS ngram, count(*) AS c FROM c3 GROUP BY 1), c1 AS MATERIALIZED (SELECT substr(ngram, 2, 1) AS ngram, count(*) AS c FROM c2 GROUP BY 1),
counted AS MATERIALIZED (SELECT 3 AS n, * FROM c3 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 1, * FROM c1)
"""


def _counted(spark, sf_dir):
    return ngram_lm.counts(_tokens(spark, sf_dir).select(X.normalize(F.col("word")).alias("word")))


@query(f"WITH {_COUNTS} SELECT n, replace(ngram, chr(1), '^') AS ngram, c FROM counted")
def lm_counts(spark, sf_dir):
    return _counted(spark, sf_dir).withColumn("ngram", F.translate("ngram", ngram_lm.PAD, "^"))


_DISC = "disc AS MATERIALIZED (SELECT n, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, CASE WHEN n1 * n2 = 0 THEN 0.5 ELSE CAST(n1 AS DOUBLE) / (n1 + 2 * n2) END AS d FROM counted GROUP BY n)"


@query(f"WITH {_COUNTS}, {_DISC} SELECT n, n1, n2, round(d, 9) AS d FROM disc")
def lm_discounts(spark, sf_dir):
    return ngram_lm.discounts(_counted(spark, sf_dir)).withColumn("d", F.round("d", 9))


@query(f"WITH {_COUNTS}, {_DISC}, r AS MATERIALIZED (SELECT n, ngram, c, d, left(ngram, n - 1) AS ctx FROM counted JOIN disc USING (n)), t AS MATERIALIZED (SELECT n, ctx, sum(c) AS total, count(*) AS kinds, any_value(d) AS d FROM r GROUP BY n, ctx), own AS (SELECT n, ngram, ln((c - r.d) / total) AS logp FROM r JOIN t USING (n, ctx)), back AS (SELECT n - 1 AS n, ctx AS ngram, ln(kinds * d / total) AS logbackoff FROM t) SELECT n, replace(ngram, chr(1), '^') AS ngram, round(logp, 6) AS logp, round(logbackoff, 6) AS logbackoff FROM own FULL JOIN back USING (n, ngram)")
def lm_logprob(spark, sf_dir):
    out = ngram_lm.probabilities(keep(_counted(spark, sf_dir)))
    return out.select("n", F.translate("ngram", ngram_lm.PAD, "^").alias("ngram"), F.round("logp", 6).alias("logp"), F.round("logbackoff", 6).alias("logbackoff"))
