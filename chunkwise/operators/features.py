"""Ordered per-frame measurements to features of a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.functions.scalar import guarded_corr


def _series(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def flicker(frames: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of a series, and largest and population variance of its neighbours' differences; 0 without differences."""
    d = F.abs(F.col(value) - F.lag(value).over(_series(keys, order)))
    return frames.withColumn("__d", d).groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_value"), F.coalesce(F.max("__d"), F.lit(0.0)).alias("max_flicker"), F.coalesce(F.var_pop("__d"), F.lit(0.0)).alias("flicker_variance"))


def asymmetry(frames: DataFrame, keys: list[str], order: list[str], left: str, right: str) -> DataFrame:
    """Mean of both sides, largest difference of neighbours on either, largest difference between the sides."""
    w = _series(keys, order)
    step = F.greatest(F.abs(F.col(left) - F.lag(left).over(w)), F.abs(F.col(right) - F.lag(right).over(w)))
    gap = F.abs(F.col(left) - F.col(right))
    return frames.withColumns({"__d": step, "__g": gap}).groupBy(*keys).agg(F.avg((F.col(left) + F.col(right)) / 2).alias("mean_value"), F.coalesce(F.max("__d"), F.lit(0.0)).alias("max_flicker"), F.max("__g").alias("asymmetry_max"))


def axis_sync(frames: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Absolute correlation of two axes; 0 for fewer than ``least`` frames, under two pairs, or a constant axis."""
    n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    value = F.when((F.count("*") < least) | (n < 2), F.lit(0.0)).otherwise(F.abs(guarded_corr(x, y)))
    return frames.groupBy(*keys).agg(value.alias("axis_sync"), F.count("*").alias("n_frames"))


def coordinate_jitter(points: DataFrame, keys: list[str], coordinates: list[str]) -> DataFrame:
    """Mean over coordinates of their population variances."""
    n = len(coordinates)
    return points.groupBy(*keys).agg((sum((F.var_pop(c) for c in coordinates), F.lit(0.0)) / n).alias("jitter"), F.count("*").alias("n_frames"))


def relative_jitter(frames: DataFrame, keys: list[str], order: list[str], f0: str, rms: str, silence: float = 1e-4) -> DataFrame:
    """Jitter of the periods of voiced frames (f0 > 0), and shimmer of the levels above silence, each over its mean."""

    def part(values: DataFrame, v: str, name: str) -> DataFrame:
        step = values.withColumn("__d", F.abs(F.col(v) - F.lag(v).over(_series(keys, order))))
        return step.groupBy(*keys).agg(F.coalesce(F.try_divide(F.avg("__d"), F.avg(v)), F.lit(0.0)).alias(name))

    voiced = frames.where(F.col(f0) > 0).withColumn("__v", F.lit(1.0) / F.col(f0))
    loud = frames.where(F.col(rms) > silence).withColumn("__v", F.col(rms))
    both = part(voiced, "__v", "jitter").join(part(loud, "__v", "shimmer"), keys, "full_outer")
    return frames.select(*keys).distinct().join(both, keys, "left").fillna(0.0, ["jitter", "shimmer"])


def step_summary(steps: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean, least, largest and third percentile (linear) of step scores, 6 decimals, and their number."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return steps.where(F.col(score).isNotNull()).groupBy(*keys).agg(r(F.avg(score), "mean_cosine"), r(F.min(score), "min_cosine"), r(F.max(score), "max_cosine"), r(F.percentile(score, 0.03), "third_percentile"), F.count("*").alias("n_steps"))


def sync_summary(windows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean, population deviation and variance, range and number of window scores."""
    return windows.groupBy(*keys).agg(F.avg(score).alias("sync_score"), F.stddev_pop(score).alias("score_std"), F.pow(F.stddev_pop(score), 2).alias("variance"), F.min(score).alias("min_sync_score"), F.max(score).alias("max_sync_score"), F.count(score).alias("n_windows"))


def quality_gate(frames: DataFrame, keys: list[str], order: list[str], value: str, least: int = 4, still: float = 0.75, share: float = 0.9) -> DataFrame:
    """Motion of frames: mean difference, share of differences under ``still``, flags, and the gate's outcome."""
    d = F.abs(F.col(value) - F.lag(value).over(_series(keys, order)))
    found = frames.withColumn("__d", d).groupBy(*keys).agg(F.count("*").alias("num_frames"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("mean_frame_delta"), F.coalesce(F.avg((F.col("__d") < still).cast("double")), F.lit(1.0)).alias("static_like_ratio"))
    few, slow, static = F.col("num_frames") < least, F.col("mean_frame_delta") < still, F.col("static_like_ratio") > share
    flags = F.array_compact(F.array(F.when(few, "too_few_frames"), F.when(slow, "low_visual_motion"), F.when(static, "mostly_static_frames")))
    text = F.array_join("__flags", ",")
    reason = F.when(few | static, F.concat(F.lit("quality_gate_failed:"), text)).when(F.size("__flags") > 0, "success_with_quality_warning").otherwise("success")
    return found.withColumn("__flags", flags).withColumns({"quality_flags": text, "quality_ok": F.size("__flags") == 0, "reason": reason}).drop("__flags")


def landmark_quality(frames: DataFrame, key: str, slide: str, values: str) -> DataFrame:
    """Slides and frames, and how many of them have a missing or NaN coordinate in the array ``values``."""
    broken = F.exists(values, lambda v: v.isNull() | F.isnan(v.cast("double")))
    by_slide = frames.groupBy(key, slide).agg(F.count("*").alias("f"), F.count_if(broken).alias("b"))
    total = by_slide.groupBy(key).agg(F.count("*").alias("n_slides"), F.count_if(F.col("b") > 0).alias("broken_slides"), F.sum("f").alias("n_frames"), F.sum("b").alias("broken_frames"))
    return total.withColumn("broken_pct", F.try_divide(F.lit(100.0) * F.col("broken_frames"), F.col("n_frames")))
