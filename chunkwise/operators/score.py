"""Scores of segments from reconstruction errors, and the evidence that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.arrays import top_named, total
from chunkwise.functions.scalar import col, interpretation, level, normalized_score


def masked_mean_square(errors: list, seen: list) -> Column:
    """Sum of squared errors of observed features over their number, at least 1."""
    square = sum((F.when(s, col(e) * col(e)).otherwise(0.0) for e, s in zip(errors, map(col, seen), strict=True)), F.lit(0.0))
    n = sum((col(s).cast("int") for s in seen), F.lit(0))
    return square / F.greatest(F.lit(1), n)


def kl_divergence(mu, logvar) -> Column:
    """Of N(mu, exp(logvar)) from N(0, 1), summed over the arrays."""
    return F.lit(-0.5) * total(F.zip_with(mu, logvar, lambda m, v: F.lit(1.0) + v - m * m - F.exp(v)))


def _precision(logvar, weight: Column) -> Column:
    return F.transform(logvar, lambda x: weight * F.exp(-x))


def product_of_experts(mus: list, logvars: list, available: list) -> tuple[Column, Column]:
    """Mean and log variance arrays of the product of the available experts and N(0, 1)."""
    precision, weighted = None, None
    for m, v, a in zip(mus, logvars, available, strict=True):
        p = _precision(v, F.when(col(a), 1.0).otherwise(0.0))
        mp = F.zip_with(m, p, lambda x, y: x * y)
        precision = F.transform(p, lambda x: x + 1.0) if precision is None else F.zip_with(precision, p, lambda x, y: x + y)
        weighted = mp if weighted is None else F.zip_with(weighted, mp, lambda x, y: x + y)
    return F.zip_with(weighted, precision, lambda x, y: x / (y + 1e-8)), F.transform(precision, lambda x: -F.log(x + 1e-8))


def joint_score(visual, audio, audio_available, kl, beta: float = 1.0) -> Column:
    return col(visual) + F.when(col(audio_available), col(audio)).otherwise(0.0) + F.lit(beta) * col(kl)


def with_levels(scores: DataFrame, joint: str, limits: DataFrame) -> DataFrame:
    """Scores with threshold, normalized_score and level; ``limits`` is the one row of ``threshold``."""
    out = scores.join(F.broadcast(limits.select("threshold")))
    return out.withColumn("normalized_score", normalized_score(joint, "threshold")).withColumn("level", level("normalized_score"))


def evidence(rows: DataFrame, names: list[str], errors: list[str], lvl: str, n: int) -> DataFrame:
    """Rows with the names of their largest errors, the unobserved features, and an interpretation."""
    missing = F.array_compact(F.array(*[F.when(F.col(e).isNull(), F.lit(x)) for x, e in zip(names, errors, strict=True)]))
    out = rows.withColumns({"top_anomalous_features": top_named(names, errors, n), "missing_features": missing})
    return out.withColumn("interpretation", interpretation(F.col("top_anomalous_features"), lvl))


def evidence_reports(chunks: DataFrame, videos: DataFrame, payload: list[str]) -> DataFrame:
    """One nested report per video: status and a map of chunk_id to the payload; videos without chunks have an empty map."""
    maps = chunks.groupBy("video_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", F.struct(*payload).alias("value"))))).alias("chunks"))
    out = videos.select("video_id").distinct().join(maps, "video_id", "left")
    return out.withColumn("status", F.when(F.col("chunks").isNull(), "no_valid_chunks").otherwise("analyzed"))


def branch_fusion(rows: DataFrame, scaled_branches: list[str], plain: str) -> DataFrame:
    """Mean of branches, of which all but ``plain`` are scaled to 0..1 over all rows; constant ones are 0."""
    ends = rows.agg(*[f(c).alias(f"{c}__{n}") for c in scaled_branches for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.join(F.broadcast(ends))
    part = {f"{c}_scaled": F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__lo"), F.col(f"{c}__hi") - F.col(f"{c}__lo")), F.lit(0.0)) for c in scaled_branches}
    out = out.withColumns(part).drop(*ends.columns)
    return out.withColumn("fused", (sum((F.col(c) for c in part), F.lit(0.0)) + F.col(plain)) / (len(part) + 1))
