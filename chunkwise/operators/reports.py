"""Reports and what is made of them: patches, summaries, contexts of features, groups of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.functions.scalar import severity, signal

from .prefix import exact_percentiles
from .scale import ranks_in_baseline

DONE, ANALYZED = "audio_artifacts_completed", "fully_analyzed"


def patched(report: DataFrame, patch: DataFrame, part: str) -> DataFrame:
    """A new version of report chunks (video_id, chunk_id, status, ``part``): the patch's payload where it has one for the chunk.

    A video with a patched chunk is fully analyzed; patches of unknown chunks change nothing.
    """
    new = patch.select("video_id", "chunk_id", F.col(part).alias("__new"), F.lit(True).alias("__has"))
    met = report.join(new, ["video_id", "chunk_id"], "left")
    has = F.coalesce("__has", F.lit(False))
    any_ = F.max(has).over(Window.partitionBy("video_id"))
    return met.withColumns({part: F.when(has, F.col("__new")).otherwise(F.col(part)), "status": F.when(any_, ANALYZED).otherwise(F.col("status"))}).select(report.columns)


def with_audio(report: DataFrame, audio: DataFrame, part: str) -> DataFrame:
    """Report chunks with the payload of their audio, null where it failed; reports that are done stay as they are.

    ``audio`` has video_id, chunk_id, ok and ``part``, one row for a chunk.
    """
    done = F.coalesce(F.col("status") == DONE, F.lit(False))
    new = audio.where("ok").select("video_id", "chunk_id", F.col(part).alias("__new"))
    met = report.join(new, ["video_id", "chunk_id"], "left")
    return met.withColumns({part: F.when(done, F.col(part)).otherwise(F.col("__new")), "status": F.lit(DONE)}).select(report.columns)


def sync_video_summary(chunks: DataFrame, key: str, chunk: str, status: str, score: str) -> DataFrame:
    """Per video: chunks, those ok, skipped and in error, mean and population deviation, best and worst chunk (ties: the first)."""
    ok = (F.col(status) == "ok") & F.col(score).isNotNull()
    value = F.when(ok, F.col(score))
    edge = lambda sign: F.min(F.when(ok, F.struct((sign * F.col(score)).alias("s"), F.col(chunk).alias("c"))))["c"]
    return chunks.groupBy(key).agg(
        F.count("*").alias("num_chunks"),
        F.count_if(ok).alias("num_ok"),
        F.count_if(F.col(status) == "skipped").alias("num_skipped"),
        F.count_if(F.col(status) == "error").alias("num_error"),
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
        edge(F.lit(-1.0)).alias("best_chunk"),
        F.max(value).alias("best_chunk_score"),
        edge(F.lit(1.0)).alias("worst_chunk"),
        F.min(value).alias("worst_chunk_score"),
    )


def feature_contexts(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows (feature, value, ...) with ``entry``: value, genuine_p50 and genuine_p95 (4 decimals), percentile_rank and signal.

    Where the value is null or the baseline (feature, value) has no such feature, the entry has the value only.
    """
    known = exact_percentiles(base, "value", [0.5, 0.95], ["feature"]).select("feature", F.round(F.col("percentiles")[0], 4).alias("__p50"), F.round(F.col("percentiles")[1], 4).alias("__p95"))
    met = ranks_in_baseline(rows, base).join(F.broadcast(known), "feature", "left")  # a row for each feature
    there = F.col("value").isNotNull() & F.col("__p50").isNotNull()
    entry = F.struct(F.col("value").alias("value"), *[F.when(there, c).alias(n) for n, c in (("genuine_p50", F.col("__p50")), ("genuine_p95", F.col("__p95")), ("percentile_rank", F.col("percentile_rank")), ("signal", signal("percentile_rank")))])
    return met.withColumn("entry", entry).drop("__p50", "__p95", "percentile_rank")


def modalities(visual: Column, audio_visual: Column) -> tuple[Column, Column]:
    """Arrays of the modalities that are there and of those that are not."""
    named = ((visual, "visual"), (audio_visual, "audio_visual"))
    return F.array_compact(F.array(*[F.when(c, n) for c, n in named])), F.array_compact(F.array(*[F.when(~c, n) for c, n in named]))


def text_evidence(chunk: str = "chunk") -> Column:
    """struct of a report chunk's transcripts and of the scores that are read with them."""
    av = f"{chunk}.audio_visual_consistency"
    places = {"asr_text_audio": "transcripts", "vsr_text_lips": "transcripts", "wer_score": "transcripts", "percentile_3rd_cosine": "semantic_consistency", "sync_score": "temporal_sync", "min_sync_score": "temporal_sync"}
    return F.struct(*[F.col(f"{av}.{where}.{name}").alias(name) for name, where in places.items()])


def frame_groups(top_chunks: Column, folder: Column) -> Column:
    """struct(label, paths) of each chunk of a package (chunk_id, start_sec, end_sec, frame_files) that has frames, in their order."""
    some = F.filter(top_chunks, lambda c: F.coalesce(F.size(c["frame_files"]), F.lit(0)) > 0)
    label = lambda c: F.format_string("Frames for %s [%.1fs-%.1fs]", F.coalesce(c["chunk_id"], F.lit("?")), F.coalesce(c["start_sec"], F.lit(0.0)), F.coalesce(c["end_sec"], F.lit(0.0)))
    return F.transform(some, lambda c: F.struct(label(c).alias("label"), F.transform(c["frame_files"], lambda f: F.concat_ws("/", folder, f)).alias("paths")))


# Worst severities of the groups visual, facial, audio-visual and audio, and what they speak for.
PATTERNS = [
    (("CRITICAL", "CRITICAL", "NORMAL", "NORMAL"), "FACE SWAP"),
    (("NORMAL", "NORMAL", "CRITICAL", "CRITICAL"), "AUDIO DEEPFAKE"),
    (("ELEVATED", "CRITICAL", "CRITICAL", "NORMAL"), "LIP SYNC / REENACTMENT"),
    (("CRITICAL", "CRITICAL", "CRITICAL", "CRITICAL"), "FULL SYNTHESIS"),
    (("NORMAL", "NORMAL", "NORMAL", "NORMAL"), "GENUINE"),
]


def manipulation_type(groups: list) -> Column:
    """What the worst severities of the four groups speak for; UNCERTAIN if no pattern fits."""
    out = F.when(F.lit(False), "")
    for pattern, name in PATTERNS:
        fits = F.lit(True)
        for g, s in zip(groups, pattern, strict=True):
            fits = fits & (F.col(g) == s)
        out = out.when(fits, name)
    return out.otherwise("UNCERTAIN")


def worst_severities(rows: DataFrame, keys: list[str], feature: str = "feature", sig: str = "signal") -> DataFrame:
    """``keys`` and, for each group of the glossary, group_1 to group_4: the worst severity of its features, NORMAL if it has none."""
    grade = F.when(severity(feature, sig) == "CRITICAL", 2).when(severity(feature, sig) == "ELEVATED", 1).otherwise(0)
    names = F.array(F.lit("NORMAL"), F.lit("ELEVATED"), F.lit("CRITICAL"))
    worst = [F.get(names, F.coalesce(F.max(F.when(F.col(feature).isin(list(members)), grade)), F.lit(0))).alias(f"group_{i}") for i, members in enumerate(spec.GLOSSARY.values(), 1)]
    return rows.groupBy(*keys).agg(*worst)


def long_enough(rows: DataFrame, frames: str, fps: str, least: float = 1.5, strict: bool = False) -> DataFrame:
    """Chunks of at least ``least`` seconds; of more, if ``strict``."""
    seconds = F.try_divide(F.col(frames), F.col(fps))
    return rows.where(seconds > least if strict else seconds >= least)


def first_rows(rows: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows in order, or all without a limit: a limit of work that the user asks for."""
    return rows if n is None else rows.orderBy(*order).limit(n)
