"""Sliding chunks over streams (an extension: the batch operators are in ``operators.segment``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_chunks(events: DataFrame, time: str, keys: list[str], value: str, length: str = "4 days", stride: str = "2 days", late: str = "1 day") -> DataFrame:
    """Number, mean, range and population variance of a value in each window, once the watermark has passed it.

    Windows are aligned to the epoch.  Runs on batch rows too, where the watermark has no effect.
    """
    w = F.window(time, length, stride)
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.var_pop(value).alias("variance"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "least", "most", "variance")


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append finished windows as Parquet; returns the running query."""
    writer = chunks.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
