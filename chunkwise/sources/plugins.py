"""The boundary to pixel, audio and language models: functions over Arrow batches, registered by name.

A plug-in maps an iterator of pandas frames to an iterator of pandas frames,
so a model is loaded once per task.  No model is shipped, as none can be without
its weights (measures that need none are in ``operators.media``); the columns
that each kind gives are fixed, so the relational operators don't depend on
which plug-in ran.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Plugin = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: What a plug-in of each kind gives for each row, besides the keys.
OUTPUTS = {
    "speech": "ok boolean, text string, reason string, duration_sec double",
    "lips": "ok boolean, hypothesis string, reason string, num_frames int",
    "sharpness": "frame_idx int, value double",
    "texture": "frame_idx int, left double, right double",
    "edges": "frame_idx int, value double",
    "landmarks": "frame_idx int, points array<array<double>>",
    "pitch": "frame_idx int, f0 double, rms double",
    "embeddings": "step int, audio array<double>, video array<double>",
    "sync": "window_idx int, score double",
}
_REGISTERED: dict[tuple[str, str], Plugin] = {}


def register(kind: str, name: str, plugin: Plugin) -> None:
    if kind not in OUTPUTS:
        raise ValueError(f"unknown kind of plug-in: {kind}")
    _REGISTERED[kind, name] = plugin


def apply(rows: DataFrame, kind: str, name: str, keys: list[str]) -> DataFrame:
    """The plug-in's rows: ``keys`` as they came, and the columns of its kind."""
    if (kind, name) not in _REGISTERED:
        raise ValueError(f"no plug-in {name} of kind {kind}")
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(_REGISTERED[kind, name], f"{types}, {OUTPUTS[kind]}")


def speech_options(language: str | None = None, english_only: bool = False, condition_on_previous: bool = False, beams: int = 0, repetition_penalty: float = 1.0, no_repeat: int = 0) -> dict[str, object]:
    """How a speech model is asked to write; a model of English alone is told neither task nor language."""
    wanted = {
        "num_beams": (int(beams), beams > 0),
        "condition_on_prev_tokens": (bool(condition_on_previous), True),
        "repetition_penalty": (float(repetition_penalty), repetition_penalty > 1),
        "no_repeat_ngram_size": (int(no_repeat), no_repeat > 0),
        "task": ("transcribe", not english_only),
        "language": (language, bool(language) and not english_only),
    }
    return {name: value for name, (value, given) in wanted.items() if given}
