"""Prompts of the reasoning model, rendered by native expressions, and the boundary to the model itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.scalar import severity
from chunkwise.operators.retrieve import top_chunks, video_summary
from chunkwise.spec import GLOSSARY

from .prompt_texts import NO_CHUNKS, RULE, TASK, THIN_RULE


def block_a(top: Column) -> Column:
    """The head of a prompt, from the columns of ``video_summary`` and an array of top chunks."""
    line = lambda c: F.format_string("  %s  [%.1fs-%.1fs]  score=%.4f  %s", c["chunk_id"], c["start_sec"], c["end_sec"], c["score"], F.upper(c["level"]))
    head = F.format_string(
        f"{RULE}\nVIDEO ANALYSIS REQUEST\n{RULE}\nVideo ID     : %s\nDuration     : %ss\nTotal chunks : %d analyzed\nThreshold    : %s (95th percentile of genuine baseline)\n\n"
        "ANOMALY SCORE DISTRIBUTION:\n  Mean score : %.4f\n  Max score  : %.4f\n  Chunks above threshold: %d / %d\n\nTOP CHUNKS:\n%s",
        "video_id",
        F.coalesce(F.col("video_duration_sec").cast("string"), F.lit("0")),
        "total_chunks",
        F.coalesce(F.format_string("%.4f", "threshold"), F.lit("n/a")),
        F.coalesce("mean_score", F.lit(0.0)),
        F.coalesce("max_score", F.lit(0.0)),
        "chunks_above_threshold",
        "total_chunks",
        F.concat(F.array_join(F.transform(top, line), "\n"), F.when(F.size(top) > 0, "\n").otherwise("")),
    )
    return F.concat(head, F.lit("\n  Temporal pattern: "), F.coalesce("temporal_pattern", F.lit("NONE")))


def feature_line(name: str, entry: Column) -> Column:
    """A line for an elevated or critical feature; null for normal or unobserved ones.

    ``entry`` is struct(value, genuine_p50, percentile_rank, signal).
    """
    sev = severity(F.lit(name), F.coalesce(entry["signal"], F.lit("NORMAL")))
    p50 = F.coalesce(F.format_string("%.4f", entry["genuine_p50"]), F.lit("-"))
    rank = F.coalesce(entry["percentile_rank"].cast("string"), F.lit("-"))
    text = F.format_string("  %-24s %10s  genP50=%8s  pct=%3s  ** %s **", F.lit(name), F.format_string("%.4f", entry["value"]), p50, rank, sev)
    return F.when(entry["value"].isNotNull() & (sev != "NORMAL"), text)


def block_b(chunk: Column, entries: Callable[[str], Column | None]) -> Column:
    """The evidence of one chunk: its head, then each group's lines and its normal features."""
    absent = F.array_join(chunk["modalities_missing"], ", ")
    head = F.concat(
        F.format_string(
            f"{THIN_RULE}\n%s  |  Time: %.1fs-%.1fs  |  Frames: %d attached\nAnomaly Score: %.4f  (level %s)\nModalities analyzed: %s",
            chunk["chunk_id"], chunk["start_sec"], chunk["end_sec"], chunk["n_frames"], chunk["score"], chunk["level"],
            F.coalesce(F.nullif(F.array_join(chunk["modalities_analyzed"], ", "), F.lit("")), F.lit("none")),
        ),
        F.when(absent != "", F.concat(F.lit("\nModalities ABSENT: "), absent)).otherwise(""),
    )
    groups = []
    for group, names in GLOSSARY.items():
        found = [(n, e) for n in names if (e := entries(n)) is not None]
        if not found:
            continue
        rows = [feature_line(n, e) for n, e in found]
        normal = [F.when(e["value"].isNotNull() & r.isNull(), F.lit(n)) for (n, e), r in zip(found, rows, strict=True)]
        listed = F.concat_ws(", ", *normal)
        lines = F.concat_ws("\n", *rows, F.when(listed != "", F.concat(F.lit("  [NORMAL] "), listed)))
        groups.append(F.when(lines != "", F.concat(F.lit(group + "\n"), lines)))
    return F.concat(head, F.lit("\n\n"), F.concat_ws("\n\n", *groups))


def user_prompt(top: Column, evidence: Column | None = None) -> Column:
    """The whole prompt; a video without chunks is to be answered UNCERTAIN."""
    tail = F.lit(f"{RULE}\n{TASK}")
    body = F.concat_ws("\n\n", block_a(top), *([evidence] if evidence is not None else []), tail)
    return F.when(F.coalesce(F.size(top), F.lit(0)) == 0, F.concat_ws("\n\n", block_a(F.array().cast("array<struct<chunk_id:string,start_sec:double,end_sec:double,score:double,level:string>>")), F.lit(NO_CHUNKS), tail)).otherwise(body)


def prompts(chunks: DataFrame, k: int = 5) -> DataFrame:
    """(video_id, prompt) from scored chunks: video_id, chunk_id, start_sec, end_sec, score, threshold, level.

    With ``entries``, a map of each chunk's features to their contexts (see ``feature_contexts``), and n_frames,
    modalities_analyzed and modalities_missing, the prompt has the evidence of each top chunk, in order of rank.
    """
    more = ("entries", "n_frames", "modalities_analyzed", "modalities_missing") if "entries" in chunks.columns else ()
    fields = ("chunk_id", "start_sec", "end_sec", "score", "level", *more)
    # a map can't be sorted, but ranks are distinct
    ranked = F.array_sort(F.collect_list(F.struct("rank", *fields)), lambda a, b: a["rank"] - b["rank"])
    top = top_chunks(chunks, k=k).groupBy("video_id").agg(ranked.alias("top"))
    rows = video_summary(chunks).join(top, "video_id", "left")
    evidence = F.array_join(F.transform("top", lambda c: block_b(c, lambda n: F.try_element_at(c["entries"], F.lit(n)))), "\n\n") if more else None
    return rows.select("video_id", user_prompt(F.col("top"), evidence).alias("prompt"))


def rule_based_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A stand-in for a reasoning model: counts the prompt's severity marks and answers in the asked format."""
    for prompts_ in batches:
        marks = prompts_.str.count(r"\*\* CRITICAL \*\*")
        label = marks.map(lambda n: "FAKE" if n >= 3 else "GENUINE" if n == 0 else "UNCERTAIN")
        fake = (marks >= 3).map({True: "true", False: "false"})
        yield '<think>counted severity marks</think><verdict>{"video_fake": ' + fake + ', "audio_fake": false, "label": "' + label + '", "confidence": "LOW"}</verdict>'


#: Backends by name; each maps an iterator of prompts to an iterator of answers.
BACKENDS: dict[str, Callable[[Iterator[pd.Series]], Iterator[pd.Series]]] = {"rules": rule_based_model}


def answered(prompts_: DataFrame, backend: str = "rules") -> DataFrame:
    """Prompts with the model's answer; ``backend`` is a key of BACKENDS."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}")
    return prompts_.withColumn("answer", F.pandas_udf(_typed(BACKENDS[backend]), "string")("prompt"))


def _typed(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from f(batches)

    return run
