"""How the driver's tables stand for recordings: one day is one second of a user's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: user_id, event_id, t (days since the epoch above), value, k (from props), event_type."""
    e = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(86400000000.0)
    return e.select("user_id", "event_id", t.alias("t"), "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"), "event_type")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("duration"))


def chunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame in each of its sliding chunks."""
    from chunkwise.operators.segment import chunks_containing

    rows = frames(spark, sf_dir).join(durations(spark, sf_dir), "user_id")
    out = chunks_containing(rows, "t", F.col("duration"))
    start = F.col("chunk_idx") * F.lit(2.0)
    return out.withColumns({"chunk_id": F.format_string("chunk_%04d", "chunk_idx"), "start_sec": start, "end_sec": F.round(F.least(start + 4.0, F.col("duration")), 6)})


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of measured features; a discount of 0 is unobserved; returns 'N' are genuine."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *FEATURES)
    return rows.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: fake if quality is 0, score from the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 0).alias("fake"), (F.col("toxic") == 1).alias("toxic"), F.round(F.log(F.lit(1.0) + F.col("n_chars")), 6).alias("score"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


ROOT = "store/interim"


def slide_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of slides, as if each event had left a file: every third user's chunks are in a cache, clicks are landmarks."""
    e = frames(spark, sf_dir)
    cache = F.when(F.col("user_id") % 3 == 0, "/cache").otherwise("")
    kind = F.when(F.col("event_type") == "click", "landmarks").otherwise("faces")
    path = F.format_string(f"{ROOT}/user_%d%s/chunk_%04d/slides/slide_%03d_%s.npy", "user_id", cache, F.floor(F.col("t") / 4).cast("int"), (F.col("event_id") % 12).cast("int"), kind)
    return e.select(path.alias("path")).distinct()
