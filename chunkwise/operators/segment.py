"""Cutting timelines into segments: chunks, slides, runs, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.functions.scalar import col


def sliding_chunks(rows: DataFrame, duration: str, length: float = spec.CHUNK_SEC, stride: float = spec.STRIDE_SEC, least: float = spec.MIN_CHUNK_SEC, fps: float = spec.FPS) -> DataFrame:
    """One row per overlapping chunk of each row's ``duration``: chunk_idx, chunk_id, start_sec, end_sec, start_frame, end_frame.

    Chunks start every ``stride``; the last are cut at the end and dropped if shorter than ``least``; numbers keep gaps.
    """
    d = F.col(duration).cast("double")
    starts = F.when(d > 0, F.sequence(F.lit(0), F.floor(d / stride).cast("int"))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda i: (i * stride < d) & (F.least(i * stride + length, d) - i * stride >= least))
    out = rows.withColumn("chunk_idx", F.explode(kept))
    start, end = F.col("chunk_idx") * F.lit(stride), F.least(F.col("chunk_idx") * F.lit(stride) + length, d)
    out = out.withColumns({"start_sec": F.round(start, 6), "end_sec": F.round(end, 6)})
    return out.withColumns({"chunk_id": F.format_string("chunk_%04d", "chunk_idx"), "start_frame": F.bround(start * fps).cast("int"), "end_frame": F.bround(end * fps).cast("int")})


def tumbling_slides(chunks: DataFrame, length: float = spec.SLIDE_SEC) -> DataFrame:
    """One row per slide of each chunk (chunk_id, start_sec, end_sec): slide_idx, slide_id, slide_start, slide_end."""
    n = F.ceil((F.col("end_sec") - F.col("start_sec")) / length).cast("int")
    out = chunks.where(n > 0).withColumn("slide_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("start_sec") + F.col("slide_idx") * F.lit(length)
    return out.withColumns({"slide_id": F.concat("chunk_id", F.lit("_slide_"), F.lpad(F.col("slide_idx").cast("string"), 3, "0")), "slide_start": F.round(start, 6), "slide_end": F.round(F.least(start + length, F.col("end_sec")), 6)})


def chunks_containing(rows: DataFrame, t: str, duration: Column, length: float = spec.CHUNK_SEC, stride: float = spec.STRIDE_SEC, least: float = spec.MIN_CHUNK_SEC) -> DataFrame:
    """Each row once for every chunk that holds its time ``t``: a constant number, so no join is needed."""
    at = F.col(t)
    first = F.greatest(F.lit(0), F.floor((at - length) / stride).cast("int") + 1)
    last = F.floor(at / stride).cast("int")
    starts = F.filter(F.sequence(F.least(first, last), last), lambda i: (i * stride <= at) & ((at < i * stride + length) | (at == duration)) & (at <= i * stride + length) & (i * stride < duration) & (F.least(i * stride + length, duration) - i * stride >= least))
    return rows.withColumn("chunk_idx", F.explode(starts))


def physical_slide(frame_idx, fps, length: float = spec.SLIDE_SEC) -> Column:
    """Number of the slide of a frame, for slides of a whole number of frames."""
    return F.floor(col(frame_idx) / F.greatest(F.lit(1), F.bround(col(fps) * length))).cast("int")


def longest_run(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """(key, run_start, run_end, run_length) of each key's longest run of consecutive numbers; the first of equally long ones."""
    numbered = rows.select(key, idx).where(F.col(idx).isNotNull()).distinct()
    island = F.col(idx) - F.row_number().over(Window.partitionBy(key).orderBy(idx))
    runs = numbered.withColumn("island", island).groupBy(key, "island").agg(F.min(idx).alias("run_start"), F.max(idx).alias("run_end"), F.count("*").alias("run_length"))
    best = runs.groupBy(key).agg(F.min(F.struct((-F.col("run_length")).alias("minus"), F.col("run_start"), F.col("run_end"), F.col("run_length"))).alias("best"))
    return best.select(key, "best.run_start", "best.run_end", "best.run_length")


def refined_times(start, first_slide, frames, fps: float = spec.FPS, length: float = spec.SLIDE_SEC) -> tuple[Column, Column]:
    """Start and end of what a chunk keeps, from its first slide and number of frames."""
    begin = col(start) + col(first_slide) * F.lit(length)
    return F.round(begin, 3), F.round(begin + col(frames) / F.lit(fps), 3)


def overlap_dedupe(rows: DataFrame, keys: list[str], start: str, order: str) -> DataFrame:
    """Of rows with the same start (6 decimals) the first by start, then ``order``; rows without a start all stay."""
    timed = rows.where(F.col(start).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys, F.round(start, 6)).orderBy(start, order))
    return timed.withColumn("__rank", rank).where("__rank = 1").drop("__rank").unionByName(rows.where(F.col(start).isNull()))


def kept_chunks(slides: DataFrame, keys: list[str], valid: str, more_than: int = 3) -> DataFrame:
    """Chunks with more than ``more_than`` valid slides: keys, n_valid."""
    return slides.groupBy(*keys).agg(F.count_if(F.col(valid)).alias("n_valid")).where(F.col("n_valid") > more_than)


def slide_acceptance(frames: DataFrame, keys: list[str], fatal: str, real: str, ratio: float = 1.0) -> DataFrame:
    """Slides and whether they are accepted: none fatal, and enough of the frames real."""
    found = frames.groupBy(*keys).agg(F.coalesce(F.bool_or(fatal), F.lit(False)).alias("any_fatal"), F.count_if(F.col(real)).alias("n_real"), F.count("*").alias("n_frames"))
    return found.withColumn("accepted", ~F.col("any_fatal") & (F.col("n_real") >= F.col("n_frames") * ratio))
