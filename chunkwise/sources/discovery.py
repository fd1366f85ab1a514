"""Folders and files of recordings, chunks and slides: columns derived from a listing of paths, so nothing is walked on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.functions.scalar import col, natural_number
from chunkwise.operators.segment import longest_run

from .readers import checked_mode

#: Which folders hold the chunks of a recording: any depth from two on; directly below it, else in its cache; both, with a slides folder.
VARIANTS = ("deep", "direct_else_cache", "both_with_slides")


def pipeline_paths(mode: str, root: str) -> dict[str, str]:
    """The folders of a run by name; an unknown mode is an error."""
    checked_mode(mode)
    return {"project_root": root, "raw_dir": f"{root}/data/raw/{mode}", "interim_dir": f"{root}/data/interim/{mode}", "processed_dir": f"{root}/data/processed/{mode}", "final_reports_dir": f"{root}/final_reports_{mode}"}


def parts_below(path, root: str) -> Column:
    """The names of a path below ``root``; null if it isn't there."""
    below = F.regexp_replace(col(path), "^" + re.escape(root.rstrip("/")) + "/", "")
    return F.when(col(path).startswith(root.rstrip("/") + "/"), F.split(below, "/"))


def layout_groups(files: DataFrame, root: str, mode: str) -> DataFrame:
    """The recordings of a layout with ``layout_group``: train or val of genuine ones, else the folder of their method.

    Genuine recordings elsewhere are left out.  Others are taken from the folders of methods, or, if there is none, from the root itself.
    """
    checked_mode(mode)
    parts = parts_below("path", root)
    rows = files.withColumn("__parts", parts).where(F.size("__parts") <= 2)
    if mode == "genuine":
        out = rows.where((F.size("__parts") == 2) & F.col("__parts")[0].isin("train", "val"))
    else:
        nested = files.select((F.max(F.size(parts)) > 1).alias("__nested"))
        out = rows.join(F.broadcast(nested)).where(F.coalesce("__nested", F.lit(False)) == (F.size("__parts") == 2)).drop("__nested")
    return out.withColumn("layout_group", F.when(F.size("__parts") == 2, F.col("__parts")[0])).drop("__parts")


def chunk_folders(files: DataFrame, root: str, variant: str = "deep") -> DataFrame:
    """(video_id, chunk_id, chunk_dir, chunk_number) of the chunk folders that hold files, by one of VARIANTS; a folder comes once."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    rows = files.select(parts_below("path", root).alias("p")).where("p is not null")
    name = lambda i: F.get("p", i)
    chunk = lambda i: F.coalesce(name(i).startswith("chunk_"), F.lit(False)) & (F.size("p") > i + 1)
    cached = (name(F.lit(0)) != "") & (name(F.lit(1)) == "cache") & chunk(F.lit(2))
    direct = chunk(F.lit(1))
    if variant == "deep":
        at = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i >= 1) & chunk(i))
        found = rows.select("p", F.explode(at).alias("at"))
    else:
        found = rows.select("p", F.when(direct, F.lit(1)).when(cached, F.lit(2)).alias("at")).where("at is not null")
    if variant == "both_with_slides":
        found = found.where(F.get("p", F.col("at") + 1) == "slides").where(F.size("p") > F.col("at") + 2)
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice("p", 1, F.col("at") + 1), "/"))
    out = found.select(name(F.lit(0)).alias("video_id"), F.get("p", F.col("at")).alias("chunk_id"), folder.alias("chunk_dir"), (F.col("at") == 2).alias("cached")).distinct()
    if variant == "direct_else_cache":  # the cache counts where no chunk is directly below
        out = out.withColumn("__direct", F.min("cached").over(Window.partitionBy("video_id"))).where("not cached or __direct").drop("__direct")
    return out.select("video_id", "chunk_id", "chunk_dir", natural_number("chunk_id", r"chunk_(\d+)$").alias("chunk_number"))


def slide_files(files: DataFrame) -> DataFrame:
    """(slides_dir, slide_id, slide_idx, kind, path) of the face and landmark arrays."""
    pattern = r"^(.*)/((slide_(\d+))_(faces|landmarks)\.npy)$"
    cut = lambda i: F.regexp_extract("path", pattern, i)
    return files.where(F.col("path").rlike(pattern)).select(cut(1).alias("slides_dir"), cut(3).alias("slide_id"), cut(4).cast("int").alias("slide_idx"), cut(5).alias("kind"), "path")


def matched_slides(files: DataFrame) -> DataFrame:
    """Face arrays with the landmarks of the same slide: slides_dir, slide_id, slide_idx, faces_path, landmarks_path."""
    slides = slide_files(files)
    side = lambda kind: slides.where(F.col("kind") == kind).select("slides_dir", "slide_id", "slide_idx", F.col("path").alias(f"{kind}_path"))
    return side("faces").join(side("landmarks"), ["slides_dir", "slide_id", "slide_idx"])


def slide_pairs(files: DataFrame) -> DataFrame:
    """The matched slides of the longest run of consecutive slides of each folder; the first of equally long runs."""
    pairs = matched_slides(files)
    runs = longest_run(pairs, "slides_dir", "slide_idx")
    return pairs.join(runs, "slides_dir").where(F.col("slide_idx").between(F.col("run_start"), F.col("run_end"))).select(pairs.columns)


def discovered_pairs(files: DataFrame, root: str) -> DataFrame:
    """(video_id, chunk_id, faces_path, landmarks_path) of all matched slides of chunks directly below their video."""
    p = parts_below("slides_dir", root)
    rows = matched_slides(files).withColumn("p", p).where((F.size("p") == 3) & F.col("p")[1].startswith("chunk_") & (F.col("p")[2] == "slides"))
    return rows.select(F.col("p")[0].alias("video_id"), F.col("p")[1].alias("chunk_id"), "faces_path", "landmarks_path")


def with_video_file(chunks: DataFrame, files: DataFrame, root: str, name: str = "video.mp4") -> DataFrame:
    """Chunks (video_id, chunk_id, ...) with ``video_path``, null where the chunk's folder has none: its frames are optional."""
    p = parts_below("path", root)
    found = files.where((F.size(p) == 3) & (p[2] == name)).select(p[0].alias("video_id"), p[1].alias("chunk_id"), F.col("path").alias("video_path"))
    return chunks.join(found, ["video_id", "chunk_id"], "left")


def slide_records(slides: DataFrame, chunks: DataFrame) -> DataFrame:
    """Slides (chunk_dir, slide_idx, ...) with start_sec and end_sec from their chunk's ``slides`` metadata, by position; null past its end."""
    meta = chunks.select("chunk_dir", F.col("slides").alias("__slides"))
    at = F.get("__slides", F.col("slide_idx"))
    return slides.join(meta, "chunk_dir", "left").withColumns({"start_sec": at["start_sec"], "end_sec": at["end_sec"]}).drop("__slides")


def recording_fps(chunks: DataFrame, key: str, order: list[str], override: float | None = None, default: float = 25.0) -> DataFrame:
    """(key, fps): the override, else the first rate in order of the chunks that isn't null, else the default."""
    first = F.min(F.when(F.col("fps").isNotNull(), F.struct(*order, F.col("fps").cast("double").alias("fps"))))["fps"]
    return chunks.groupBy(key).agg(F.lit(float(override)).alias("fps") if override is not None else F.coalesce(first, F.lit(default)).alias("fps"))
