"""Splits of videos into training and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums, with_place


def greedy_split(videos: DataFrame, key: str, size: str, ratio: float, tie: Column | None = None) -> DataFrame:
    """Videos with ``subset``: the shortest go to val until it has max(1, round(total * ratio)) chunks; train keeps one.

    Equal sizes are in order of ``tie``, then key.  Without a positive ratio, with under two videos or no chunks, all train.
    The running sum needs one order of all videos, so it is taken over sizes first, then within a size, both by ranges.
    """
    tie = F.col(key) if tie is None else tie
    rows = with_place(videos.withColumn("__tie", tie), "__tie", "__place").withColumn("__one", F.lit(1))
    by_size = rows.groupBy(size).agg(F.count("*").alias("__videos")).withColumn("__chunks", F.col(size) * F.col("__videos"))
    sums = running_sums(by_size, size, {"__before": "__chunks", "__first": "__videos"}).drop("__chunks", "__videos")
    sums = sums.join(F.broadcast(by_size.agg(F.sum("__chunks").alias("__total"), F.sum("__videos").alias("__n"))))
    out = running_sums(rows, "__place", {"__at": "__one"}, ["__tie", key], by=[size]).join(sums, size)
    before = F.col("__before") + F.col("__at") * F.col(size)
    target = F.greatest(F.lit(1), F.bround(F.col("__total") * F.lit(float(ratio))))
    val = (F.lit(ratio) > 0) & (F.col("__n") >= 2) & (F.col("__total") > 0) & (before < target) & (F.col("__first") + F.col("__at") < F.col("__n") - 1)
    return out.withColumn("subset", F.when(val, "val").otherwise("train")).select(*videos.columns, "subset")


def manifest_split(videos: DataFrame, manifest: DataFrame, key: str, usage: str, train: str, val: str) -> DataFrame:
    """Videos with ``subset`` by their usage in the manifest; others are dropped."""
    used = manifest.where(F.col(usage).isin(train, val)).select(key, F.when(F.col(usage) == train, "train").otherwise("val").alias("subset"))
    return videos.join(used, key)


def balance_select(videos: DataFrame, ids: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """The ``n`` listed videos with the most chunks; ties by key; videos without chunks are left out."""
    return videos.join(ids.select(key).distinct(), key).where(F.col(size) > 0).orderBy(F.desc(size), key).limit(n)


def round_robin(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows with ``shard``, 0 to n - 1 in turn in order of the columns ``order``."""
    placed = with_place(rows, order[0], "__place").withColumn("__one", F.lit(1))
    numbered = running_sums(placed, "__place", {"__at": "__one"}, order)
    return numbered.withColumn("shard", F.pmod("__at", F.lit(n)).cast("int")).select(*rows.columns, "shard")
