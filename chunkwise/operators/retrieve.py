"""Retrieval: the top chunks of each video, its summary, its package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.functions.scalar import temporal_pattern


def top_chunks(chunks: DataFrame, key: str = "video_id", score: str = "score", order: str = "chunk_id", k: int = spec.TOP_CHUNKS) -> DataFrame:
    """The ``k`` chunks of each key with the largest scores, with their rank; ties by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score), order))
    return chunks.withColumn("rank", rank).where(F.col("rank") <= k)


def largest_chunk(chunks: DataFrame, key: str = "video_id", score: str = "score", order: str = "chunk_id") -> DataFrame:
    """The chunk of each key with the largest score; scores that are null or not over -1 don't count; ties by ``order``."""
    best = chunks.where(F.col(score) > -1).groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("m"), F.col(order).alias("o"))).alias("b"))
    return best.select(key, F.col("b.o").alias(order), (-F.col("b.m")).alias(score))


def video_summary(chunks: DataFrame, key: str = "video_id", score: str = "score", limit: str = "threshold", start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Number, mean and largest score, chunks at or over the threshold, duration, and the pattern of those chunks."""
    over = F.col(score) >= F.col(limit)
    found = chunks.groupBy(key).agg(
        F.count("*").alias("total_chunks"),
        F.max(limit).alias("threshold"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.round(F.max(score), 6).alias("max_score"),
        F.count_if(over).alias("chunks_above_threshold"),
        F.max(end).alias("video_duration_sec"),
        F.min(F.when(over, F.col(start))).alias("__first"),
        F.max(F.when(over, F.col(start))).alias("__last"),
    )
    return found.withColumn("temporal_pattern", temporal_pattern("chunks_above_threshold", "__first", "__last", "video_duration_sec")).drop("__first", "__last")


def packages(chunks: DataFrame, payload: list[str], key: str = "video_id", k: int = spec.TOP_CHUNKS) -> DataFrame:
    """One row per video: its summary and its top chunks, in order of rank (``k`` at most)."""
    top = top_chunks(chunks, key, k=k).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *payload))).alias("top_chunks"))
    summary = video_summary(chunks, key)
    return summary.select(key, F.struct(*[c for c in summary.columns if c != key]).alias("video_summary")).join(top, key, "left").withColumn("top_chunks", F.coalesce("top_chunks", F.expr("array()")))
