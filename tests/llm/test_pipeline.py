import sentencepiece

import corpus_pipeline as cp
from lexweave.llm import packing, secrets


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        now = now.cache()
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] < sizes[2]
    press = secrets.compressor()
    assert not any(secrets.scan(r.text, press) for r in now.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=packing.MODEL)
    left = {r.doc_id: len(library.encode(r.text)) for r in now.collect() if r.text}
    got = cp.run(spark, sf).toPandas()
    assert got.groupby("doc_id").tokens.sum().to_dict() == left
    fills = got.groupby(["shard", "window"]).tokens.sum()
    assert fills.max() <= packing.CAPACITY
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "pack"]


def test_odd_rows_pass_every_stage(spark, odd):
    now = odd
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == odd.columns
        empty = stage(spark, odd.limit(0), "")
        assert empty.columns == odd.columns and empty.collect() == []
    assert cp.STAGES[-1][1](spark, odd.limit(0), "").collect() == []
    assert sorted(str(r[0]) for r in now.collect()) == ["1", "5", "None"]


def test_an_empty_table_passes_the_whole_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_each_stage_does_its_part(spark, make):
    """Clean documents stay as they are; what is planted for one stage is caught by it."""
    clean = [(i, "\n".join(f"document {i} line {k} holds word{i * 31 + k} and word{i * 17 + k * 7} alone" for k in range(6)), f"h{i % 3}") for i in range(30)]
    footer = "subscribe to our letter for more of this"
    boiler = [(100 + i, "\n".join([f"text {i} number {k} goes with mark{i * 13 + k}" for k in range(5)] + [footer]), "hot") for i in range(14)]
    passage = "\n".join(f"shared passage line {k} with a good many words that stand here to be found again" for k in range(8))
    runs = [(200, f"own start of the first\n{passage}", "r"), (201, f"another start altogether, of the second one here\n{passage}\nand an end of its own", "r")]
    base = [f"w{k * 37 % 1009}" for k in range(80)]
    near = [(300, " ".join(base), "n"), (301, " ".join([*base[:40], "changed", *base[41:]]), "n")]
    secret = [(400, "config of the service follows\ntoken = 'q7ZxP20vLk81TbnM4s'\nend of the config", "s")]
    now = make(*clean, *boiler, *runs, *near, *secret)
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, "").cache()
    left = {r.doc_id: r.text for r in now.collect()}
    assert all(left[i] == t for i, t, _ in clean) and not any(footer in t for t in left.values())
    assert left[200] == runs[0][1] and left[201] == "another start altogether, of the second one here\nand an end of its own"
    assert 300 in left and 301 not in left and secrets.MASK in left[400] and "q7Zx" not in left[400]
    assert set(left) == {i for i, *_ in clean} | {100 + i for i in range(14)} | {200, 201, 300, 400}
