"""Queries of tags, unknown words, constraints and annotation over the test tables, with their DuckDB texts; registered in ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from ..functions import text as X
from ..operators import active, analysis, lines, linear, ngram_lm, ngrams, subwords, tagging, training
from ..operators.storage import keep
from ..sources import formats
from . import queries as Q
from .queries import query, table

_SPLIT = "[ \\t\\r\\f\\x0b\\n]+"
_WS = r"list_filter(string_split_regex(text, '[ \t\r\f\x0b\n]+'), lambda w: w <> '')"
_TK = f"""
talk AS MATERIALIZED (SELECT *, {Q._types('norm')} AS types FROM (SELECT *, {Q._norm("array_to_string(ws, '')")} AS norm FROM (SELECT row_number() OVER () AS rid, conv_id, turn, role AS tag, {_WS} AS ws FROM conversations WHERE text IS NOT NULL) WHERE len(ws) > 0)),
tk AS MATERIALIZED (SELECT *, CAST(sum(size) OVER (PARTITION BY rid ORDER BY i) - size AS BIGINT) AS start FROM
 (SELECT rid, conv_id, turn, tag, CAST(i AS INTEGER) AS i, {Q._norm('w')} AS word, length(w) AS size, norm, types FROM (SELECT *, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM talk)))
"""
_CONTEXT = """
ar AS (SELECT *, substr(norm, start - nb + 1, nb) || substr(norm, start + size + 1, 3) AS ax, substr(types, start - nb + 1, nb) || substr(types, start + size + 1, 3) AS ay FROM (SELECT *, least(start, 3) AS nb FROM tk)),
ctx AS MATERIALIZED (SELECT rid, i, word, tag, kind || CAST(1 - nb + j AS VARCHAR) || substr(CASE kind WHEN 'X' THEN ax ELSE ay END, j + 1, n) AS name FROM
 (SELECT *, unnest(range(1, least(3, length(ax) - j) + 1)) AS n FROM (SELECT *, unnest(range(length(ax))) AS j FROM ar)), (VALUES ('X'), ('T')) k(kind))
"""
_SELF = "own AS (SELECT rid, i, word, tag, unnest(['SX' || word, 'ST' || substr(types, start + 1, size)]) AS name FROM tk)"
_ENTRIES = f"""
offered AS (SELECT {Q._norm('w')} AS word, tag, bit FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS w, 'user' AS tag, 1 AS bit FROM benchmark UNION ALL SELECT unnest(string_split(p_name, ' ')), 'assistant', 2 FROM part UNION ALL SELECT unnest(string_split_regex(text, '[ \n]+')), 'assistant', 2 FROM benchmark) WHERE w <> ''),
entries AS (SELECT word, tag, mask, row_number() OVER (PARTITION BY word ORDER BY f) - 1 AS tag_index FROM
 (SELECT word, tag, bit_or(bit) AS mask, min(f) AS f FROM (SELECT word, tag, 0 AS bit, (0, conv_id, turn, i, tag) AS f FROM tk UNION ALL SELECT word, tag, bit, (1, bit, 0, 0, tag) FROM offered) GROUP BY word, tag)),
dn AS MATERIALIZED (SELECT word, CASE WHEN bool_or(mask > 0) THEN list_sort(list_distinct(flatten(list(list_filter([CASE WHEN mask & 1 > 0 THEN 'D0T' || tag_index END, CASE WHEN mask & 2 > 0 THEN 'D1T' || tag_index END], lambda x: x IS NOT NULL))))) ELSE ['UNK'] END AS names FROM entries GROUP BY word)
"""
_SCORES = f"""{_TK}, {_CONTEXT}, {_SELF}, {_ENTRIES},
feats AS MATERIALIZED (SELECT rid, i, tag, name FROM ctx UNION ALL SELECT rid, i, tag, name FROM own UNION ALL SELECT rid, i, tag, unnest(names) FROM tk JOIN dn USING (word)),
cl AS (SELECT tag, CAST(trunc(1000 * (2 * count(*) - sum(count(*)) OVER ()) / (sum(count(*)) OVER () + 4)) AS BIGINT) AS bias FROM tk GROUP BY tag),
tot AS (SELECT name, count(*) AS n FROM feats GROUP BY name), pos AS (SELECT name, tag, count(*) AS p FROM feats GROUP BY name, tag),
wt AS MATERIALIZED (SELECT name, cl.tag, 1000 * (2 * coalesce(p, 0) - n) // (n + 4) AS w FROM tot CROSS JOIN cl LEFT JOIN pos USING (name, tag)),
sc AS MATERIALIZED (SELECT f.rid, f.i, wt.tag, CAST(sum(w) AS BIGINT) + any_value(bias) AS s FROM feats f JOIN wt USING (name) JOIN cl ON cl.tag = wt.tag GROUP BY f.rid, f.i, wt.tag)
"""


def _talk(spark, sf_dir) -> DataFrame:
    """Conversation turns as sentences whose words have the role as tag."""
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    return tagging.tagged_words(talk.select("conv_id", "turn", F.col("role").alias("tag"), F.filter(F.split("text", _SPLIT), lambda w: w != "").alias("words")))


def _entries(spark, sf_dir, words: DataFrame) -> DataFrame:
    """(word, tag, tag_index, tag_in_dict): tags in the order of first sight, the corpus' before the dictionaries'."""

    def offered(name: str, column: str, pattern: str, tag: str, bit: int) -> DataFrame:
        each = table(spark, sf_dir, name).select(F.explode(F.split(column, pattern)).alias("w")).where("w <> ''")
        return each.select(X.normalize(F.col("w")).alias("word"), F.lit(tag).alias("tag"), F.lit(bit).alias("bit"), F.struct(F.lit(1).alias("a"), F.lit(bit).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("d"), F.lit(tag).alias("e")).alias("seen"))

    rows = words.select("word", "tag", F.lit(0).alias("bit"), F.struct(F.lit(0).alias("a"), F.col("conv_id").alias("b"), F.col("turn").alias("c"), F.col("i").alias("d"), F.col("tag").alias("e")).alias("seen"))
    for part in (offered("benchmark", "text", "[ \\n]+", "user", 1), offered("part", "p_name", " ", "assistant", 2), offered("benchmark", "text", "[ \\n]+", "assistant", 2)):
        rows = rows.unionByName(part)
    tags = rows.groupBy("word", "tag").agg(F.min("seen").alias("seen"), F.bit_or("bit").alias("tag_in_dict"))
    return tags.select("word", "tag", (F.row_number().over(W.partitionBy("word").orderBy("seen")) - 1).alias("tag_index"), "tag_in_dict")


@query(f"WITH {_TK}, {_CONTEXT} SELECT name, tag, count(*) AS n FROM ctx GROUP BY name, tag")
def tag_ngrams(spark, sf_dir):
    """The n-grams around words, by the words' tags."""
    names = F.concat(tagging.context("norm", "X"), tagging.context("types", "T"))
    return _talk(spark, sf_dir).select("tag", F.explode(names).alias("name")).groupBy("name", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {_TK}, {_SELF} SELECT name, tag, count(*) AS n FROM own GROUP BY name, tag")
def self_features(spark, sf_dir):
    return _talk(spark, sf_dir).select("tag", F.explode(tagging.self_names()).alias("name")).groupBy("name", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {_TK}, {_ENTRIES} SELECT name, count(*) AS words FROM (SELECT unnest(names) AS name FROM dn) GROUP BY name")
def tag_dict_features(spark, sf_dir):
    """How many words have each tag-dictionary feature."""
    names = tagging.dictionary_names(_entries(spark, sf_dir, _talk(spark, sf_dir)))
    return names.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("words"))


def _scored(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Each word's tags scored by all its features, with weights from counts."""
    words = _talk(spark, sf_dir)
    names = tagging.dictionary_names(_entries(spark, sf_dir, words))
    # what stands around the words is kept; the names of the features, many times as long, are made of it where they are needed
    words = keep(tagging.slim(words).join(names, "word"))
    feats = F.concat(tagging.context("norm", "X"), tagging.context("types", "T"), tagging.self_names(F.col("own_types")), "names")
    rows = words.select("conv_id", "turn", "i", "tag", feats.alias("features"))
    classes = linear.classes_of(words)
    weights = keep(linear.counted_weights(rows, classes))
    return linear.score_features(rows, weights, linear.class_bias(words, classes), kept=True), classes


@query(f"WITH {_SCORES} SELECT conv_id, turn, i, sc.tag, s AS score FROM sc JOIN tk USING (rid, i)")
def tag_scores(spark, sf_dir):
    scored, classes = _scored(spark, sf_dir)
    return scored.select("conv_id", "turn", "i", F.explode(F.arrays_zip(F.array(*map(F.lit, classes)).alias("tag"), F.col("scores").alias("score"))).alias("x")).select("conv_id", "turn", "i", "x.tag", "x.score")


@query(f"WITH {_SCORES} SELECT conv_id, turn, i, tags FROM (SELECT rid, i, string_agg(tag || ':' || s, ' ' ORDER BY s DESC, tag) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY s DESC, tag) AS r FROM sc) WHERE r <= 2 GROUP BY rid, i) JOIN tk USING (rid, i)")
def tag_topk(spark, sf_dir):
    """The two best tags of each word."""
    scored, classes = _scored(spark, sf_dir)
    best = F.slice(linear.ranked(F.col("scores"), classes), 1, 2)
    return scored.select("conv_id", "turn", "i", F.array_join(F.transform(best, lambda p: F.concat(p["tag"], F.lit(":"), p["score"].cast("string"))), " ").alias("tags"))


@query(f"WITH {_SCORES} SELECT conv_id, turn, i, best.tag AS best, best.s - second.s AS margin, best.tag = tk.tag AS right_ FROM (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY s DESC, tag) AS r FROM sc) best JOIN (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY s DESC, tag) AS r FROM sc) second USING (rid, i) JOIN tk USING (rid, i) WHERE best.r = 1 AND second.r = 2")
def tag_margin(spark, sf_dir):
    """The best tag of each word and by how much it leads the second."""
    scored, classes = _scored(spark, sf_dir)
    two = scored.withColumn("two", linear.ranked(F.col("scores"), classes))
    return two.select("conv_id", "turn", "i", F.col("two")[0]["tag"].alias("best"), (F.col("two")[0]["score"] - F.col("two")[1]["score"]).alias("margin"), (F.col("two")[0]["tag"] == F.col("tag")).alias("right_"))


@query(f"""WITH {_TK}, {_CONTEXT}, amb AS MATERIALIZED (SELECT word FROM tk GROUP BY word HAVING count(DISTINCT tag) > 1),
cl AS (SELECT DISTINCT word, tag FROM tk JOIN amb USING (word)), f AS MATERIALIZED (SELECT * FROM ctx JOIN amb USING (word)),
tot AS (SELECT word, name, count(*) AS n FROM f GROUP BY word, name), pos AS (SELECT word, name, tag, count(*) AS p FROM f GROUP BY word, name, tag),
wt AS (SELECT word, name, cl.tag, 1000 * (2 * coalesce(p, 0) - n) // (n + 4) AS w FROM tot JOIN cl USING (word) LEFT JOIN pos USING (word, name, tag)),
sc AS (SELECT rid, i, word, wt.tag, sum(w) AS s FROM f JOIN wt USING (word, name) GROUP BY rid, i, word, wt.tag),
best AS (SELECT rid, i, word, arg_min(tag, (-s, tag)) AS tag FROM sc GROUP BY rid, i, word)
SELECT word, count(*) AS n, count(*) FILTER (best.tag = tk.tag) AS correct FROM best JOIN tk USING (rid, i, word) GROUP BY word""")
def local_models(spark, sf_dir):
    """A model for each ambiguous word, of what stands around it; how often it is right."""
    return tagging.local_counts(tagging.slim(_talk(spark, sf_dir)))


# trained models
def _lines_of(spark, sf_dir) -> DataFrame:
    """Benchmark passages as annotated sentences: the blanks are their word boundaries."""
    rows = table(spark, sf_dir, "benchmark").where("text is not null").select(F.posexplode(F.split("text", "\n")).alias("n", "line"), "item_id")
    return formats.parse(rows.select(training.order_key("item_id", "n").alias("seen"), "line"), "tok", "line").where(F.size("words") > 0)


def _train_report(spark, sf_dir, solver: int) -> DataFrame:
    """A segmenter trained on the benchmark by a solver over all partitions, and how it does on the same lines."""
    gold = keep(_lines_of(spark, sf_dir))
    model = training.train_spread(gold, Config(solver=solver, tag=False))
    blank = gold.select("seen", F.col("ws_confs").alias("gold"), F.col("surface").alias("line"))
    found = analysis.analyze(formats.parse(blank, "raw", "line"), model)
    pair = F.arrays_zip(F.col("gold").alias("g"), F.col("ws_signed").alias("s"))
    same = F.size(F.filter(pair, lambda p: (p["g"] > 0) == (p["s"] > 0)))
    return found.agg(F.lit(solver).alias("solver"), F.sum(F.size("gold")).alias("points"), F.sum(same).alias("correct"))


@query()
def svm_train(spark, sf_dir):
    return _train_report(spark, sf_dir, 3)


@query()
def lr_train(spark, sf_dir):
    return _train_report(spark, sf_dir, 0)


# unknown words
_PART = "[" + X.normalize_text("aeiou") + "].|[^" + X.normalize_text("aeiou") + "]"
_WORDS = f"{_TK}, pairs AS MATERIALIZED (SELECT DISTINCT word FROM tk), aligned AS MATERIALIZED (SELECT word, parts FROM (SELECT word, regexp_extract_all(word, '{_PART}') AS parts FROM pairs) WHERE array_to_string(parts, '') = word)"


def _aligned(spark, sf_dir) -> DataFrame:
    """Words and readings (here themselves) side by side; vowels are offered with what follows them only."""
    words = _talk(spark, sf_dir).select("word").distinct()
    spelled = words.select(F.col("word"), F.col("word").alias("tag"))
    parts = words.select(F.explode(F.regexp_extract_all(F.col("word"), F.lit(_PART), F.lit(0))).alias("word")).distinct()
    return subwords.alignments(spelled, parts.select("word", F.col("word").alias("tag"), F.col("word").alias("seen")))


@query(f"WITH {_WORDS} SELECT word AS tag, array_to_string(parts, ' ') AS parts FROM aligned")
def subword_align(spark, sf_dir):
    return _aligned(spark, sf_dir).select("tag", F.array_join(F.transform("parts", lambda p: p["subword"]), " ").alias("parts"))


@query(f"WITH {_WORDS}, c AS (SELECT p, count(*) AS c FROM (SELECT unnest(parts) AS p FROM aligned) GROUP BY p), h AS (SELECT c, count(*) AS m FROM c GROUP BY c) SELECT c AS k, CAST(sum(m) OVER (ORDER BY c DESC) AS BIGINT) AS n FROM h")
def atleast_k_hist(spark, sf_dir):
    """How many subwords were counted at least k times."""
    counts = _aligned(spark, sf_dir).select(F.explode("parts.subword").alias("p")).groupBy("p").agg(F.count("*").alias("c"))
    return subwords.at_least_histogram(counts, "c")


@query()
def unk_tag_candidates(spark, sf_dir):
    """Readings of the benchmark's words, as unknown words of a model of the conversations' words."""
    vocab = _talk(spark, sf_dir).select("word").distinct()
    offers = vocab.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("word")).distinct()
    both = offers.select("word", F.lit(0).alias("level"), F.explode(F.array(F.col("word"), F.concat("word", "word"))).alias("tag"), F.lit("~").alias("seen"))
    sub, lm = subwords.train(vocab.select("word", F.lit(0).alias("level"), F.col("word").alias("tag")), both, [0], Config())
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \\n]+")).alias("w")).where("w <> ''").select(X.normalize(F.col("w")).alias("word")).distinct()
    return subwords.tag_words(words, sub, lm, 0, Config())


# segmentation: all scores, the constraint applied, annotation kept
@query(Q._SEG + Q._SCORES + "SELECT doc_id, line_no, count(s) AS points, coalesce(CAST(sum(s) AS BIGINT), 0) AS total, min(s) AS lowest, max(s) AS highest FROM g LEFT JOIN (SELECT lo, s FROM (SELECT lo, CAST(lo + unnest(range(size - 1)) AS BIGINT) AS pos FROM g) JOIN scores USING (pos)) USING (lo) GROUP BY lo, doc_id, line_no")
def ws_scores(spark, sf_dir):
    """The scores of all boundaries, summed up by line."""
    gold, evidence = Q._evidence(spark, sf_dir)
    out = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold), scores="all")
    return out.select("doc_id", "line_no", F.size("scores").cast("bigint").alias("points"), ngrams.total_of("scores").alias("total"), F.array_min("scores").alias("lowest"), F.array_max("scores").alias("highest"))


@query(Q._SEG + Q._SCORES + ", hits AS (SELECT lo, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS breaks FROM (SELECT lo, b, x, y FROM (SELECT lo, b, CAST(lo + b AS BIGINT) AS pos, substr(types, CAST(b AS INTEGER) + 1, 1) AS x, substr(types, CAST(b AS INTEGER) + 2, 1) AS y FROM (SELECT lo, types, unnest(range(size - 1)) AS b FROM g)) JOIN scores USING (pos) WHERE s > 0) WHERE NOT (x = y AND x IN ('D', 'H')) GROUP BY lo) SELECT doc_id, line_no, coalesce(breaks, '') AS breaks FROM g LEFT JOIN hits USING (lo)")
def ws_constrained(spark, sf_dir):
    """Segmentation that never breaks between two digits or two hiragana."""
    gold, evidence = Q._evidence(spark, sf_dir)
    out = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold))
    out = out.withColumn("types", ngrams.types_of("norm"))
    return out.select("doc_id", "line_no", F.array_join(ngrams.constrained("breaks", "types", "DH"), " ").alias("breaks"))


@query(Q._SEG + Q._SCORES + ", merged AS (SELECT lo, b, CASE WHEN c IN ('a', 'e') THEN brk ELSE s > 0 END AS cut FROM (SELECT lo, b, CAST(lo + b AS BIGINT) AS pos, substr(surface, CAST(b AS INTEGER) + 1, 1) AS c FROM (SELECT lo, surface, unnest(range(size - 1)) AS b FROM g)) JOIN bounds USING (pos) JOIN scores USING (pos)), hits AS (SELECT lo, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS breaks FROM merged WHERE cut GROUP BY lo) SELECT doc_id, line_no, coalesce(breaks, '') AS breaks FROM g LEFT JOIN hits USING (lo)")
def partial_merge(spark, sf_dir):
    """Partially annotated lines, what follows an a or e being known, segmented: annotation stays, the rest is filled in."""
    gold, evidence = Q._evidence(spark, sf_dir)
    whole = formats.marked(F.col("words"), "|", "-", known="ae")
    partial = formats.parse(gold.select("doc_id", "line_no", whole.alias("line")), "part", "line")
    scored = ngrams.score_lines(partial.select("doc_id", "line_no", "norm", "ws_confs"), keep(ngrams.associate(evidence)), ngrams.break_bias(gold), scores="all")
    return scored.select("doc_id", "line_no", F.array_join(ngrams.merged_breaks("ws_confs", "scores"), " ").alias("breaks"))


# formats: tags, open marks, tag scores
@query(f"SELECT doc_id, line_no, surface, len(ends) AS words, len(list_filter(ends, lambda i: i = 1 OR len(words[i - 1]) % 2 = 0)) AS certain, CAST(len(list_filter(ends, lambda i: i < len(words))) AS INTEGER) AS breaks, length(surface) - len(words) AS inner_places, array_to_string(list_transform(ends, lambda i: 'L' || length(words[i])), ' ') AS tags FROM (SELECT *, list_filter(range(1, len(words) + 1), lambda i: len(words[i]) % 2 = 0 OR i = len(words)) AS ends FROM ({Q._GOLD}))")
def part_tags_read(spark, sf_dir):
    """Partially annotated lines with tags and open marks: words of odd lengths have an open end."""
    gold = lines.gold(table(spark, sf_dir, "documents"))
    tag = lambda w: F.concat(F.lit("/L"), F.length(w).cast("string"))
    parts = F.zip_with("words", "inner", lambda w, x: F.struct(w.alias("w"), x.alias("x")))
    parts = F.transform(parts, lambda p, i: (lambda w: F.concat(p["x"], F.when((F.length(w) % 2 == 0) | (i == F.size("words") - 1), tag(w)).otherwise(""), F.when(i == F.size("words") - 1, "").when(F.length(w) % 2 == 0, "|").when(F.length(w) % 3 == 0, "?").otherwise(" ")))(p["w"]))
    gold = gold.withColumn("inner", formats.marked_words(F.col("words"), "-"))
    out = formats.parse(gold.select("doc_id", "line_no", F.array_join(parts, "").alias("line")), "part", "line")
    many = lambda p: F.size(F.filter("ws_confs", p))
    tags = F.array_join(F.transform("words", lambda w: w["tags"][0][0]["tag"]), " ")
    certain = F.size(F.filter("words", lambda w: w["is_certain"]))
    return out.select("doc_id", "line_no", "surface", F.size("words").cast("bigint").alias("words"), certain.cast("bigint").alias("certain"), many(lambda c: c > 0).alias("breaks"), many(lambda c: c < 0).cast("bigint").alias("inner_places"), tags.alias("tags"))


@query(f"SELECT doc_id, line_no, CAST(len(words) AS INTEGER) AS words, CAST(length(surface) - 1 AS INTEGER) AS places, coalesce(list_sum(list_transform(words, lambda w: length(w) * 1.5)), 0) AS tag_scores FROM ({Q._GOLD})")
def conf_tags_read(spark, sf_dir):
    """Confidence blocks with a line of tag scores."""
    gold = lines.gold(table(spark, sf_dir, "documents"))
    full = F.array_join(F.transform("words", lambda w: F.concat(X.escape(w), F.lit("/L"), F.length(w).cast("string"))), " ")
    confs = F.array_join(F.array_repeat(F.lit("50"), F.length("surface") - 1), " ")
    scores = F.array_join(F.transform("words", lambda w: (F.length(w) * F.lit(1.5)).cast("string")), " ")
    out = formats.parse(gold.select("doc_id", "line_no", F.concat_ws("\n", full, confs, scores).alias("block")), "conf", "block")
    total = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["tags"][0][0]["score"])
    return out.select("doc_id", "line_no", F.size("words").alias("words"), F.size(F.filter("ws_confs", lambda c: F.abs(c) == 50)).alias("places"), total.alias("tag_scores"))


@query(rf"SELECT doc_id, line_no, CASE WHEN length(surface) <= 40 THEN array_to_string(list_transform(words, lambda w: array_to_string(list_transform(list_filter(string_split(w, ''), lambda c: c <> ''), lambda c: regexp_replace(c, '([ \-&|\\?])', '\\\1')), '-')), '|') ELSE array_to_string(list_transform(list_filter(string_split(surface, ''), lambda c: c <> ''), lambda c: regexp_replace(c, '([ \-&|\\?])', '\\\1')), ' ') END AS line FROM ({Q._GOLD})")
def merge_annotations(spark, sf_dir):
    """Lines of up to 40 characters annotated, put back in place of the corpus' own."""
    gold = lines.gold(table(spark, sf_dir, "documents")).withColumn("row", F.struct("doc_id", "line_no"))
    corpus = gold.select("row", active.split_chars(F.col("surface")).alias("line"))
    done = F.array_join(F.transform("words", lambda w: F.array_join(F.transform(X.chars(w), lambda c: X.escape(c, " -&|\\?")), "-")), "|")
    merged = active.merge_annotations(corpus, gold.where(F.length("surface") <= 40).select("row", done.alias("line")))
    return merged.select("row.doc_id", "row.line_no", "line")


# plain formats, words and scores of the symbol model
@query(f"SELECT doc_id, line_no, line AS surface, CAST(greatest(length(line) - 1, 0) AS INTEGER) AS open_places FROM ({Q._LINES})")
def raw_read(spark, sf_dir):
    out = formats.parse(lines.split_lines(table(spark, sf_dir, "documents").where("text is not null")), "raw", "line")
    return out.select("doc_id", "line_no", "surface", F.size(F.filter("ws_confs", lambda c: c == 0)).alias("open_places"))


@query(f"SELECT doc_id, line_no, array_to_string(words, ' ') AS line, array_to_string(words, '') AS raw FROM ({Q._GOLD})")
def tok_write(spark, sf_dir):
    """Sentences as tokenized and as raw lines."""
    out = formats.parse(lines.gold(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.array_join("words", " ").alias("line")), "tok", "line")
    return out.select("doc_id", "line_no", formats.write_tokenized(formats.sentence()).alias("line"), formats.write_raw(formats.sentence()).alias("raw"))


@query("SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[ .,\n]|[^ .,\n]+')) AS t FROM documents) GROUP BY t")
def tokenize(spark, sf_dir):
    """Parts between delimiters, which are parts too."""
    return table(spark, sf_dir, "documents").select(F.explode(X.tokenize(F.col("text"), " .,\n", keep=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(Q._SEG + Q._SCORES + """, cuts AS (SELECT lo, list(b ORDER BY b) AS c FROM (SELECT lo, b, CAST(lo + b AS BIGINT) AS pos FROM (SELECT lo, unnest(range(size - 1)) AS b FROM g)) JOIN scores USING (pos) WHERE s > 0 GROUP BY lo)
SELECT doc_id, line_no, array_to_string(list_transform(range(len(c) + 1), lambda k: substr(surface, CAST(CASE WHEN k = 0 THEN 1 ELSE c[k] + 2 END AS INTEGER), CAST(CASE WHEN k = len(c) THEN size ELSE c[k + 1] + 1 END - CASE WHEN k = 0 THEN 0 ELSE c[k] + 1 END AS INTEGER))), ' ') AS line FROM (SELECT g.*, coalesce(c, []) AS c FROM g LEFT JOIN cuts USING (lo))""")
def ws_words(spark, sf_dir):
    """Segmented lines as text."""
    gold, evidence = Q._evidence(spark, sf_dir)
    out = ngrams.score_lines(gold, keep(ngrams.associate(evidence)), ngrams.break_bias(gold))
    return out.select("doc_id", "line_no", F.array_join(ngrams.spans(), " ").alias("line"))


@query(f"""WITH {Q._COUNTS}, {Q._DISC}, r AS MATERIALIZED (SELECT n, ngram, c, d, left(ngram, n - 1) AS ctx FROM counted JOIN disc USING (n)), t AS MATERIALIZED (SELECT n, ctx, sum(c) AS total, count(*) AS kinds, any_value(d) AS d FROM r GROUP BY n, ctx),
own AS MATERIALIZED (SELECT n, ngram, ln((c - r.d) / total) AS logp FROM r JOIN t USING (n, ctx)), back AS MATERIALIZED (SELECT n - 1 AS n, ctx AS ngram, ln(kinds * d / total) AS b FROM t),
words AS (SELECT DISTINCT {Q._norm('w')} AS word FROM (SELECT unnest(string_split_regex(text, '[ 
]+')) AS w FROM benchmark) WHERE w <> ''),
g AS (SELECT word, substr(chr(1) || chr(1) || word, i, 3) AS g FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM words))
SELECT word, round(sum(coalesce(o3.logp, coalesce(b2.b, 0) + coalesce(o2.logp, coalesce(b1.b, 0) + coalesce(o1.logp, (SELECT b FROM back WHERE n = 0) - ln(10000))))), 6) AS logp FROM g
LEFT JOIN own o3 ON o3.n = 3 AND o3.ngram = g LEFT JOIN back b2 ON b2.n = 2 AND b2.ngram = left(g, 2) LEFT JOIN own o2 ON o2.n = 2 AND o2.ngram = substr(g, 2, 2) LEFT JOIN back b1 ON b1.n = 1 AND b1.ngram = substr(g, 2, 1) LEFT JOIN own o1 ON o1.n = 1 AND o1.ngram = substr(g, 3, 1)
GROUP BY word""")
def lm_score(spark, sf_dir):
    """The symbol model's log probability of the benchmark's words, the end not counted."""
    model = ngram_lm.probabilities(keep(Q._counted(spark, sf_dir)))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''").select(X.normalize(F.col("w")).alias("word")).distinct()
    return ngram_lm.score_words(words, model).select("word", F.round("logp", 6).alias("logp"))


# dictionary features of boundaries
_DICT_FEATURES = f"""WITH {Q._DICT}, g AS MATERIALIZED (SELECT row_number() OVER () AS rid, norm FROM ({Q._GOLD})), sizes AS (SELECT DISTINCT length(word) AS n FROM dict),
m AS MATERIALIZED (SELECT rid, j AS a, j + n - 2 AS z, n, in_dict, length(norm) AS size FROM (SELECT rid, norm, j, n, substr(norm, CAST(j AS INTEGER), CAST(n AS INTEGER)) AS word FROM (SELECT rid, norm, unnest(range(1, length(norm) + 1)) AS j FROM g), sizes WHERE j + n - 1 <= length(norm)) JOIN dict USING (word)),
s AS (SELECT rid, a - 2 AS b, 'R' AS p, n, in_dict, size FROM m UNION ALL SELECT rid, z, 'L', n, in_dict, size FROM m UNION ALL SELECT rid, unnest(range(a - 1, z)), 'I', n, in_dict, size FROM m),
f AS (SELECT DISTINCT rid, b, 'D' || d || p || least(n, 4) AS name FROM s, (VALUES (0), (1)) k(d) WHERE in_dict & (1 << d) > 0 AND b >= 0 AND b < size - 1)
SELECT name, count(*) AS n FROM f GROUP BY name"""
Q.SQL["ws_dict_features"] = _DICT_FEATURES
