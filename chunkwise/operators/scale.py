"""What is normal: baselines, robust scaling, thresholds.  Nulls are unobserved and never counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from chunkwise import spec

from .prefix import at_most, blocks, exact_percentiles, fitted, values_at


def observed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, value) of the observed values of wide rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select(F.inline(pairs)).where("value is not null")


def baseline(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, n, mean, std (population) and percentiles.  Percentile ranks take the values themselves, see ``ranks_in_baseline``."""
    marks = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    long = observed(rows, names)
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    out = stats.join(exact_percentiles(long, "value", list(marks.values()), ["feature"]), "feature")
    return out.select("feature", "n", "mean", "std", *[F.col("percentiles")[i].alias(p) for i, p in enumerate(marks)])


def _rank_counts(n: int) -> list[int]:
    """For each rank from 1 to 100 how many of ``n`` values must be at most a value for it to have that rank."""
    out = []
    for k in range(1, 101):
        c = max(0, (2 * k - 1) * n // 200 - 1)
        while round(100.0 * c / n) < k:
            c += 1
        out.append(c)
    return out


def ranks_in_baseline(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows (feature, value, ...) with ``percentile_rank`` among the baseline's (feature, value); 50 without a baseline.

    A rank is reached at one of the baseline's values, so a feature has a hundred limits, worked out at once, and
    a rank is the number of limits that a value reaches: no row of either side is gathered or shuffled by its value.
    """
    found = values_at(base, "value", lambda n: [c - 1 for c in _rank_counts(n)], ["feature"])
    limits = [(*g, blocks([v[c - 1] for c in _rank_counts(n)])) for g, (n, v) in found.items()]
    few = base.sparkSession.createDataFrame(limits, StructType([StructField("feature", base.schema["feature"].dataType), StructField("__limits", ArrayType(ArrayType(DoubleType())))]))
    met = rows.join(F.broadcast(few), "feature", "left")  # a row for each feature
    rank = F.when(F.col("__limits").isNull(), 50).otherwise(at_most("__limits", F.col("value").cast("double")))
    return met.withColumn("percentile_rank", F.when(F.col("value").isNotNull(), rank)).drop("__limits")


def scaler(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row with center and scale of each feature: median and p75 - p25, 1 where that is under 1e-8.  Worked out at once."""
    found = exact_percentiles(observed(rows, names), "value", [0.25, 0.5, 0.75], ["feature"])
    aggs = []
    for n in names:
        p = F.max(F.when(F.col("feature") == n, F.col("percentiles")))
        width = p[2] - p[0]
        aggs += [F.coalesce(p[1], F.lit(0.0)).alias(f"{n}__center"), F.when(width >= 1e-8, width).otherwise(1.0).alias(f"{n}__scale")]
    return fitted(found.agg(*aggs))


def scaled(rows: DataFrame, names: list[str], fit: DataFrame, fill: bool = False) -> DataFrame:
    """``rows`` with their features scaled; with ``fill`` unobserved ones are 0 and ``<name>__seen`` tells.

    ``fit`` has one row, so every row meets it by a broadcast.
    """
    out = rows.join(F.broadcast(fit))
    value = lambda n: (F.col(n) - F.col(f"{n}__center")) / F.col(f"{n}__scale")
    seen = {f"{n}__seen": F.col(n).isNotNull() for n in names} if fill else {}
    new = {n: F.coalesce(value(n), F.lit(0.0)) if fill else value(n) for n in names}
    return out.withColumns(seen | new).drop(*[f"{n}__{x}" for n in names for x in ("center", "scale")])


def with_masks(rows: DataFrame, names: list[str], modality: str) -> DataFrame:
    """Masks of observed features, whether the modality has any, and zeros for what is unobserved."""
    masks = {f"{n}__seen": F.col(n).isNotNull() for n in names}
    any_seen = F.lit(False)
    for n in names:
        any_seen = any_seen | F.col(n).isNotNull()
    return rows.withColumns(masks | {f"{modality}__available": any_seen}).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def threshold(scores: DataFrame, score: str, percentile: float = spec.THRESHOLD_PERCENTILE) -> DataFrame:
    """threshold (largest score + 1e-8 if the percentile isn't positive), mean, median and largest score, number; worked out at once."""
    found = exact_percentiles(scores, score, [percentile, 0.5])
    stats = scores.agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.count(score).alias("n"))
    p = F.col("percentiles")[0]
    out = stats.join(F.broadcast(found.select("percentiles")), how="left")
    out = out.select(F.when(p > 0, p).otherwise(F.col("max_score") + 1e-8).alias("threshold"), "mean_score", F.col("percentiles")[1].alias("median_score"), "max_score", "n")
    return fitted(out)
