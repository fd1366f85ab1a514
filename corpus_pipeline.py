"""A training-data pipeline: quality rules, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwise.llm.bpe import encode_decode
from chunkwise.llm.common import written
from chunkwise.llm.decontaminate import without_contaminated
from chunkwise.llm.jaccard import one_of_each
from chunkwise.llm.linededup import without_boilerplate
from chunkwise.llm.quality import fit_quality, keep_good
from chunkwise.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; all documents stay."""
    return without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with an id or without."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has no form for the classifier and the byte-pair encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
