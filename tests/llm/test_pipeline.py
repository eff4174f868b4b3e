"""The pipeline's stages on the smallest tables."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from promptscore.llm import pu_quality, simhash


def test_stages_keep_their_contract(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    original = {r.doc_id: r for r in docs.collect()}
    states = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, states[-1], folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        states.append(spark.createDataFrame(out.collect(), out.schema))
    kept = [{r.doc_id for r in s.collect()} for s in states]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[-1]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(labels[i] for i in labels if i in kept[1]) >= 0.95 * sum(labels.values())
    # texts equal in a stage's input leave one behind
    seen = {}
    for i in sorted(kept[1]):
        seen.setdefault(original[i].text, i)
    assert kept[2] <= set(seen.values())
    lines = [x for r in states[3].collect() for x in r.text.split("\n") if len(x.split()) >= 20]
    assert len(lines) == len({" ".join(x.lower().split()) for x in lines})
    assert all(r.n_chars == len(r.text) for r in states[3].collect())
    last = states[-1].collect()
    assert all(r.decodes and r.n_tokens == len(r.token_ids) for r in last)


def test_repeated_short_lines_and_passages_go(spark, folder):
    stock = "subscribe to our letter for more"
    broken = "\n".join(" ".join(f"p{row}x{i}" for i in range(18)) for row in range(3))
    words = [f"q{i}" for i in range(24)]
    narrow, wide = ("\n".join(" ".join(words[i : i + n]) for i in range(0, 24, n)) for n in (3, 4))
    texts = [f"own {i} words of it\n{stock}\n{broken}\n\n{p}\n\nthe end" for i, p in enumerate([narrow, wide, narrow])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, wide, " \n"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text.split() for r in corpus_pipeline.substrings(spark, docs, folder).collect()}
    assert set(got) == {0, 1, 2, 4} and got[0] == texts[0].split()
    assert all(got[i] == f"own {i} words of it the end".split() for i in (1, 2))


def test_empty_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_arrow_batches_do_not_grow_with_a_partition(spark, folder):
    def weighed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 8000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(1000).cast("long").alias("n_chars"),
    )
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    out = corpus_pipeline.tokens(spark, docs, folder)
    assert max(r.n for r in docs.mapInArrow(weighed, "n long").collect()) < 3 << 20
    assert out.agg(F.count_if("decodes"), F.sum("n_tokens")).first()[0] == 8000


def test_stages_use_the_operators():
    assert pu_quality.THRESHOLD == 0.3 and simhash.RADIUS == 3 and len(corpus_pipeline.STAGES) == 5
