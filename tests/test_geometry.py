import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkwise.functions import geometry as G
from chunkwise.sources import plugins

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


@pytest.fixture(scope="module")
def rows(spark):
    points = [[0.0, 0.0], [4.0, 2.0], [float("nan"), 1.0], [None, 1.0], None]
    eye = [[0.0, 0.0], [1.0, 1.0], [2.0, 1.0], [3.0, 0.0], [2.0, -1.0], [1.0, -1.0]]
    boxes = [(0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 24.0, 4.0)]
    moved = [[3.0, 4.0], [4.0, 2.0], [0.0, 0.0], [0.0, 0.0], None]
    data = [(points, moved, eye, boxes, [0.5, 1.0, None, float("nan")], [3.7, -2.0, float("inf"), None])]
    return spark.createDataFrame(data, f"p array<array<double>>, q array<array<double>>, eye array<array<double>>, boxes array<{BOX}>, u array<double>, w array<double>")


def value(rows, expr):
    return rows.select(expr.alias("x")).first()["x"]


def test_points(rows):
    assert len(value(rows, G.found_points("p"))) == 2
    assert tuple(value(rows, G.bounding_box("p"))) == (0.0, 0.0, 4.0, 2.0)
    assert value(rows, G.centered("p"))[:2] == [[-0.5, -0.25], [0.5, 0.25]]
    assert value(rows, G.center("p")) == [2.0, 1.0]
    assert value(rows, G.bounding_box(F.array().cast("array<array<double>>"))) is None
    assert value(rows, G.eye_aspect_ratio("eye")) == pytest.approx(4 / 6, abs=1e-6)
    assert value(rows, G.mean_displacement("p", "q")) == 2.5
    assert value(rows, G.mapped("q", 2.0, 1.0, 1.0, 0.0))[0] == [7.0, 4.0]
    assert value(rows, G.affine(F.array(F.lit(1.0), F.lit(2.0)), [[0, -1, 5], [1, 0, 0]])) == [3.0, 1.0]
    assert value(rows, G.yaw_ratio(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(5.0), F.lit(0.0)))) == 0.25


def test_faces(rows):
    assert value(rows, G.overlapping_least("boxes")) is True
    assert tuple(value(rows, G.chosen_face("boxes", F.lit(20.0)))) == (20.0, 0.0, 24.0, 4.0)
    assert tuple(value(rows, G.chosen_face("boxes", F.lit(None).cast("double")))) == (0.0, 0.0, 10.0, 10.0)
    assert tuple(value(rows, G.widened(F.get("boxes", F.lit(0)), 0.2, F.lit(11), F.lit(100)))) == (0.0, 0.0, 11.0, 12.0)


def test_pixels_and_samples(rows):
    assert value(rows, G.pixel_values("u")) == [127, 255, 0, 0]
    assert value(rows, G.pixel_values("w")) == [3, 0, 255, 0]
    samples = F.sequence(F.lit(0), F.lit(99)).cast("array<double>")
    assert value(rows, G.cropped_samples(samples, F.lit(1), F.lit(5), F.lit(20))) == [float(i) for i in range(10, 14)]
    assert value(rows, G.audio_status(F.lit(None).cast("array<double>"), F.lit(20))) == "missing_audio"
    assert value(rows, G.audio_status(samples, F.lit(2000))) == "too_short" and value(rows, G.audio_status(samples, F.lit(20))) == "ok"
    assert math.isclose(rows.agg(*G.kinematics(F.lit(1.0), F.lit(2.0), F.lit(0.5))).first()[0], 0.0)


def test_plugins(spark):
    def loud(batches):
        for frame in batches:
            yield pd.DataFrame({"video_id": frame["video_id"], "frame_idx": 0, "value": frame["x"] * 2})

    plugins.register("sharpness", "double", loud)
    df = spark.createDataFrame([("v", 1.5)], "video_id string, x double")
    assert tuple(plugins.apply(df, "sharpness", "double", ["video_id"]).first()) == ("v", 0, 3.0)
    with pytest.raises(ValueError):
        plugins.apply(df, "sharpness", "other", ["video_id"])
    with pytest.raises(ValueError):
        plugins.register("smell", "x", loud)


def test_speech_options():
    assert plugins.speech_options("en", english_only=True) == {"condition_on_prev_tokens": False}
    assert plugins.speech_options("en", beams=40, repetition_penalty=1.15, no_repeat=3) == {"num_beams": 40, "condition_on_prev_tokens": False, "repetition_penalty": 1.15, "no_repeat_ngram_size": 3, "task": "transcribe", "language": "en"}
    assert plugins.speech_options("") == {"condition_on_prev_tokens": False, "task": "transcribe"}
