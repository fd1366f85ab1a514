import hashlib

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkwise.llm import decontaminate, linededup, quality, queries


def test_pipeline(spark, sf_dir):
    """run() against plain versions of the stages, with the fitted model's verdicts taken as given."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.quality_rules(docs, model).where("kept").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in kept]
    rows = [(d, t) for d, _, t in brute.boilerplate(rows, linededup.MIN_SITES)]
    rows = [(d, t) for (d, t), least in zip(sorted(rows), [c for _, _, c in sorted(brute.jaccard_components(rows))]) if d == least]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, *_ in brute.contained(rows, items)}
    want = set()
    for d, t in rows:
        if d not in gone:
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = corpus_pipeline.run(spark, sf_dir)
    assert {tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256").collect()} == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, odd, none, sf_dir):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == odd.columns
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count() == frame.count()
    assert corpus_pipeline.line_dedup(spark, odd, sf_dir).where(F.col("doc_id").isNull()).count() == 2


@pytest.mark.parametrize("most", [decontaminate.MOST_SENT, 0])
def test_decontaminate_searches_rows_without_an_id(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_SENT", most)
    item = " ".join(f"item{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "so " + item), (None, "a clean text of a few words"), (None, None), (1, item + " end"), (2, "another clean text of some words"), (2, "again " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
