"""Measures of frames and samples in Arrow batches; what is made of them per chunk is in ``features``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chunkwise.functions import pixels, sound
from chunkwise.session import small_batches
from chunkwise.sources import npy


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def scaled_frames(faces: bytes | None, landmarks: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The frames of a slide with their landmarks in pixels, as many as there are of both; none if a file can't be read, isn't of images and points, or has under two faces."""
    images, points = npy.frame_list(faces), npy.frame_list(landmarks)
    if not images or not points or len(images) < 2:
        return []
    pairs = [(image, p[0] if p.ndim == 3 and len(p) else p) for image, p in zip(images, points, strict=False)]
    if not all(image.ndim in (2, 3) and image.size and image.dtype.kind in "uif" and p.ndim == 2 and p.shape[1] > 1 and p.dtype.kind in "uif" for image, p in pairs):
        return []
    size = np.array(images[0].shape[1::-1], np.float32)
    return [(image, p.astype(np.float32)[:, :2] * size) for image, p in pairs]


def frame_measures(slides: DataFrame, keys: list[str], faces: str = "faces", landmarks: str = "landmarks") -> DataFrame:
    """keys, frame_idx, sharpness, left, right (contrast of the cheeks) and edges of each frame.

    ``faces`` and ``landmarks`` are the bytes of a slide's ``.npy`` files, landmarks as shares of the image.  A slide that
    can't be read or has under two faces gives no rows.  In order of slide and frame_idx, ``features.flicker`` and
    ``features.asymmetry`` make a chunk's features of them, across its slides.
    """
    small_batches(slides.sparkSession)
    names = [*keys, "frame_idx", "sharpness", "left", "right", "edges"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                key, out = row[:-2], []
                for i, (image, points) in enumerate(scaled_frames(row[-2], row[-1])):
                    out.append((*key, i, pixels.sharpness(image, points), *pixels.texture(image, points), pixels.edge_density(image, points)))
                yield pd.DataFrame(out, columns=names)

    return slides.select(*keys, faces, landmarks).mapInPandas(run, f"{_types(slides, keys)}, frame_idx int, sharpness double, left double, right double, edges double")


def sound_features(waves: DataFrame, keys: list[str], samples: str = "samples", rate: str = "rate", stack: int = 4) -> DataFrame:
    """keys, mel (80 rows of one level a frame) and banks (log filter banks, ``stack`` frames a row) of each sound.

    Samples at another rate than 16 kHz are resampled; those that aren't finite count as 0.  Null samples or a null rate give nulls.
    """
    small_batches(waves.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for *key, wave, hz in frame.itertuples(index=False):
                if wave is None or pd.isna(hz):
                    out.append((*key, None, None))
                    continue
                a = sound.at_rate(sound.clean(np.array(wave, np.float64)), int(hz))
                out.append((*key, sound.normalized_mel(a).tolist(), sound.stacked_rows(sound.log_filter_banks(a), stack).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "mel", "banks"])

    return waves.select(*keys, samples, rate).mapInPandas(run, f"{_types(waves, keys)}, mel array<array<double>>, banks array<array<double>>")
