"""Readers of reports, evidence, verdicts, manifests, arrays and recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwise.functions.scalar import feature_columns, file_stem, truthy
from chunkwise.functions.text import VERDICT
from chunkwise.spec import FEATURES

MODES = ("genuine", "infer")
# Suffixes of recordings.
VIDEO_SUFFIXES = ["mp4", "avi", "mov", "mkv", "webm", "m4v"]
# The columns of a manifest.
MANIFEST = ["video_path", "local_path", "usage", "split", "label", "video_fake", "audio_fake", "generative_method", "audio_generative_method", "open_set_model", "open_set_language", "language", "status", "error"]


def report_schema() -> str:
    """The schema of a report: chunks are a map, so that new chunk ids make no new columns."""
    tree: dict = {}
    for _, path, _, _ in FEATURES:
        at = tree
        *parents, leaf = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = "double"
    tree["visual_spatial"].setdefault("blur", {})["mean_sharpness"] = "double"
    tree["visual_spatial"]["texture"]["mean_contrast"] = "double"
    tree["visual_spatial"]["blending"]["mean_edge_density"] = "double"
    tree["audio_visual_consistency"]["transcripts"] |= {"asr_text_audio": "string", "vsr_text_lips": "string"}
    tree["audio_visual_consistency"]["semantic_consistency"]["mean_cosine_similarity"] = "double"
    tree |= {"frames_analyzed": "int", "time_metadata": {"start_sec": "double", "end_sec": "double", "duration": "double", "source": "string"}}

    def text(node) -> str:
        return node if isinstance(node, str) else "struct<" + ", ".join(f"{k}: {text(v)}" for k, v in node.items()) + ">"

    return f"video_metadata struct<video_id: string, status: string>, chunks map<string, {text(tree)}>"


def checked_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return mode


def list_recordings(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Path, name, size and time of the recordings of a folder, without their content; ``method`` is the folder they are in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = files.select("path", "length", "modificationTime").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(VIDEO_SUFFIXES))
    return found.withColumns({"video_id": file_stem("path"), "method": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """video_id and one row per chunk: chunk_id and the nested ``chunk``; a missing video_id is the file's stem."""
    raw = spark.read.schema(report_schema() + ", _corrupt_record string").option("multiLine", True).json(path, columnNameOfCorruptRecord="_corrupt_record")
    rows = raw.withColumn("__file", F.col("_metadata.file_name")).where("_corrupt_record is null")
    stem = F.regexp_replace(F.regexp_replace("__file", r"\.json$", ""), "_report$", "")
    return rows.select(F.coalesce("video_metadata.video_id", stem).alias("video_id"), F.col("video_metadata.status").alias("status"), F.explode("chunks").alias("chunk_id", "chunk"))


def report_features(reports: DataFrame) -> DataFrame:
    """The feature columns of report chunks, with their times and texts."""
    text = "chunk.audio_visual_consistency.transcripts"
    return reports.select("video_id", "chunk_id", F.col("chunk.time_metadata.start_sec").alias("start_sec"), F.col("chunk.time_metadata.end_sec").alias("end_sec"), F.col("chunk.frames_analyzed").alias("frames_analyzed"), F.col(f"{text}.asr_text_audio").alias("asr_text"), F.col(f"{text}.vsr_text_lips").alias("vsr_text"), *feature_columns())


EVIDENCE = "video_metadata struct<video_id: string, status: string>, chunks map<string, struct<anomaly: struct<joint_anomaly_score: double, threshold: double, level: string>>>"


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Chunk scores of analysed videos; unreadable files and videos without chunks give no row."""
    raw = spark.read.schema(EVIDENCE + ", _corrupt_record string").option("multiLine", True).json(path, columnNameOfCorruptRecord="_corrupt_record")
    rows = raw.withColumn("__file", F.col("_metadata.file_name")).where("_corrupt_record is null and video_metadata.status = 'analyzed'")
    stem = F.regexp_replace("__file", r"(_evidence)?\.json$", "")
    return rows.select(F.coalesce("video_metadata.video_id", stem).alias("video_id"), F.explode("chunks").alias("chunk_id", "c")).select("video_id", "chunk_id", F.col("c.anomaly.joint_anomaly_score").alias("score"), F.col("c.anomaly.threshold").alias("threshold"), F.col("c.anomaly.level").alias("level"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts that are objects: video_id, backend, reasoning and the verdict's fields; others and unreadable files give no row."""
    raw = spark.read.schema(f"video_id string, backend string, reasoning string, raw_output string, verdict struct<{VERDICT.replace(' ', ': ').replace(',: ', ', ')}>, _corrupt_record string")
    rows = raw.option("multiLine", True).json(path, columnNameOfCorruptRecord="_corrupt_record").where("_corrupt_record is null and verdict is not null")
    return rows.select("video_id", "backend", "reasoning", "verdict.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV keyed by the stem of local_path; of rows with one key the last in the file stays."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in MANIFEST)).csv(path, header=True)
    keyed = rows.withColumns({"video_id": F.nullif(file_stem("local_path"), F.lit("")), "__at": F.monotonically_increasing_id()}).where("video_id is not null")
    last = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("__at")))).where("__rank = 1").drop("__rank", "__at")
    return last.withColumns({c: truthy(c) for c in ("video_fake", "audio_fake", "open_set_model", "open_set_language")})


def read_arrow(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """An Arrow IPC stream as rows, those with a video_path of ``prefix`` only."""
    import pyarrow as pa

    with pa.OSFile(path) as source, pa.ipc.open_stream(source) as stream:
        rows = spark.createDataFrame(stream.read_all())
    return rows.where(F.col("video_path").startswith(prefix)) if prefix else rows


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` files: path, shape and values; what can't be read has an error and no values."""
    import io

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(content))
                    out.append((name, list(a.shape), a.astype(float).ravel().tolist(), None))
                except (ValueError, EOFError, OSError) as problem:
                    out.append((name, None, None, type(problem).__name__))
            yield pd.DataFrame(out, columns=["path", "shape", "values", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, shape array<int>, values array<double>, error string")


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """``.wav`` files as mono samples in -1..1: path, rate, samples, error."""
    import io
    import wave

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                        a = np.frombuffer(w.readframes(w.getnframes()), {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(float)
                    a = (a - 128 if width == 1 else a) / (2 ** (8 * width - 1) - (width > 1))
                    out.append((name, rate, a.reshape(-1, channels).mean(1).tolist(), None))
                except (wave.Error, EOFError, KeyError, ValueError) as problem:
                    out.append((name, None, None, type(problem).__name__))
            yield pd.DataFrame(out, columns=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<double>, error string")
