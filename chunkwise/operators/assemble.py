"""Joins and set operations of stages: transcripts, reports, resumption, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.scalar import failure_cascade


def transcript_pairs(asr: DataFrame, vsr: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two transcripts (keys, ok, text) with the first reason why a pair can't be compared."""
    a = asr.select(*keys, F.col("ok").alias("asr_ok"), F.col("text").alias("asr_text"), F.lit(1).alias("__a"))
    v = vsr.select(*keys, F.col("ok").alias("vsr_ok"), F.col("text").alias("vsr_text"), F.lit(1).alias("__v"))
    out = a.join(v, keys, "full_outer").withColumn("reason", failure_cascade("__a", "__v", "asr_ok", "vsr_ok"))
    return out.withColumn("ok", F.col("reason") == "success").drop("__a", "__v")


def assembled_report(chunks: DataFrame, content: DataFrame, semantic: DataFrame, sync: DataFrame, audio: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the parts that exist for them.

    A chunk without ``content`` gets none of the three audio-visual parts; ``semantic`` and ``sync`` count only
    where their ``ok`` holds; ``audio`` is joined by itself.  Parts are (keys, payload, ok) with one row per key.
    """

    def part(df: DataFrame, name: str, need_ok: bool) -> DataFrame:
        df = df.where("ok") if need_ok else df
        return df.select(*keys, F.col("payload").alias(name), F.lit(True).alias(f"has_{name}"))

    out = chunks.join(part(content, "content", False), keys, "left").join(part(semantic, "semantic", True), keys, "left").join(part(sync, "sync", True), keys, "left").join(part(audio, "audio", False), keys, "left")
    has = F.coalesce("has_content", F.lit(False))
    for name in ("semantic", "sync"):
        out = out.withColumn(name, F.when(has, F.col(name)))
    status = F.when(F.col("has_audio"), "audio_artifacts_completed").when(has, "fully_analyzed").otherwise("visual_only")
    return out.withColumn("status", status).drop(*[f"has_{x}" for x in ("content", "semantic", "sync", "audio")])


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose output doesn't exist."""
    return work.join(done.select(*keys), keys, "left_anti")


def reusable(cache: DataFrame, reasons: list[str]) -> DataFrame:
    """Cached rows that stand: successes, and failures that a rerun can't mend."""
    return cache.where(F.coalesce("ok", F.lit(False)) | F.coalesce(F.col("reason").isin(reasons), F.lit(False)))


def to_run(work: DataFrame, cache: DataFrame, keys: list[str], reasons: list[str]) -> DataFrame:
    return pending(work, reusable(cache, reasons), keys)


def retried(rows: DataFrame, status: str, failed_too: bool = False) -> DataFrame:
    return rows.where(F.col(status).isin("pending", "failed") if failed_too else F.col(status) == "pending")


def work_list(chunks: DataFrame, inputs: DataFrame, keys: list[str], missing: str) -> DataFrame:
    """One task per chunk with input_exists, and the reason of failure of those without an input."""
    out = chunks.join(inputs.select(*keys).distinct().withColumn("__has", F.lit(True)), keys, "left")
    return out.withColumns({"input_exists": F.coalesce("__has", F.lit(False)), "reason": F.when(F.col("__has").isNull(), missing)}).drop("__has")


def read_back(expected: DataFrame, results: DataFrame, keys: list[str], corrupt: Column) -> DataFrame:
    """A row for every expected key: ok, or why there is no result."""
    found = results.select(*keys, F.lit(True).alias("__has"), corrupt.alias("__bad"))
    out = expected.join(found, keys, "left")
    reason = F.when(F.col("__has").isNull(), "missing_output_json_after_processing").when(F.col("__bad"), "manifest_read_error").otherwise("success")
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason") == "success").drop("__has", "__bad")


def stage_rollup(rows: DataFrame, key: str, ok: str = "ok", reason: str = "reason") -> DataFrame:
    """Counts per key and, with a null key, in all: total, num_ok, num_failed, num_skipped, num_missing."""
    skipped, missing = F.col(reason).startswith("skipped"), F.col(reason).contains("not_found") | F.col(reason).startswith("missing")
    done = F.coalesce(ok, F.lit(False))
    return rows.rollup(key).agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("num_ok"),
        F.count_if(~done & ~F.coalesce(skipped | missing, F.lit(False))).alias("num_failed"),
        F.count_if(~done & F.coalesce(skipped, F.lit(False))).alias("num_skipped"),
        F.count_if(~done & F.coalesce(missing, F.lit(False))).alias("num_missing"),
    )


def content_summary(rows: DataFrame, key: str, chunk: str, wer: str, score: str) -> DataFrame:
    """Per key: chunks, mean and median error rate and score, worst and best chunk (ties: the first)."""
    first = lambda sign: F.min(F.when(F.col(wer).isNotNull(), F.struct((sign * F.col(wer)).alias("w"), F.col(chunk).alias("c"))))["c"]
    return rows.groupBy(key).agg(
        F.count("*").alias("num_chunks"),
        F.avg(wer).alias("mean_wer"),
        F.percentile(wer, 0.5).alias("median_wer"),
        F.avg(score).alias("mean_score"),
        F.percentile(score, 0.5).alias("median_score"),
        first(F.lit(-1.0)).alias("worst_chunk"),
        first(F.lit(1.0)).alias("best_chunk"),
    )


def ids_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def ids_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def ids_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
