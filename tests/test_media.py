"""Measures of frames and samples, against plain recomputation."""

import io
import math

import numpy as np
import pytest

from chunkwise.functions import pixels, sound
from chunkwise.operators import features, media
from chunkwise.sources import npy


def saved(value):
    out = io.BytesIO()
    np.save(out, value, allow_pickle=True)
    return out.getvalue()


def face(random, n=468, w=40, h=48):
    points = random.random((n, 2)) * [w * 0.8, h * 0.8] + [w * 0.1, h * 0.1]
    points[pixels.SIDE_LEFT], points[pixels.SIDE_RIGHT] = (4, 20), (36, 20)
    points[pixels.CHEEK_LEFT], points[pixels.CHEEK_RIGHT] = (12, 24), (28.5, 24)
    return random.integers(0, 256, (h, w, 3), np.uint8), points


def test_hull_and_sharpness():
    random = np.random.default_rng(0)
    image, points = face(random)
    mask = pixels.hull_mask(image.shape[:2], points)
    whole = points.astype(int)
    for y in range(0, 48, 3):
        for x in range(0, 40, 3):  # outside means that some line through two points has all of them on its other side
            angles = np.sort(np.arctan2(whole[:, 1] - y, whole[:, 0] - x))
            gap = np.diff(np.append(angles, angles[0] + 2 * np.pi)).max()
            assert mask[y, x] == (gap <= np.pi + 1e-9 or [x, y] in whole.tolist()), (x, y)
    g = np.pad(pixels.gray(image).astype(float), 1, "reflect")
    found = [g[y, x + 1] + g[y + 2, x + 1] + g[y + 1, x] + g[y + 1, x + 2] - 4 * g[y + 1, x + 1] for y in range(48) for x in range(40) if mask[y, x]]
    assert pixels.sharpness(image, points) == pytest.approx(np.var(found))
    assert pixels.sharpness(image, points[:467]) == pixels.sharpness(image, None) == 0
    assert (pixels.gray(np.full((2, 2), 0.5), unit=True) == 127).all() and pixels.gray(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 29


def test_texture_against_tables():
    random = np.random.default_rng(1)
    patch = random.integers(0, 9, (7, 6))
    found = []
    for d in (1, 3):
        for angle in (0, math.pi / 4, math.pi / 2, 3 * math.pi / 4):
            table, dy, dx = np.zeros((9, 9)), round(math.sin(angle) * d), round(math.cos(angle) * d)
            for y in range(7):
                for x in range(6):
                    if 0 <= y + dy < 7 and 0 <= x + dx < 6:
                        table[patch[y, x], patch[y + dy, x + dx]] += 1
            table = (table + table.T) / (2 * table.sum())
            found.append(sum(table[i, j] * (i - j) ** 2 for i in range(9) for j in range(9)))
    assert pixels.contrast(patch) == pytest.approx(np.mean(found))
    image, points = face(random)
    g = pixels.gray(image)
    assert pixels.texture(image, points) == (pixels.contrast(g[19:29, 7:17]), pixels.contrast(g[19:29, 23:33]))
    points[pixels.SIDE_RIGHT] = (13, 20)
    assert pixels.texture(image, points) == (0, 0)


def test_edges():
    step = np.zeros((12, 12), np.uint8)
    step[:, 6:] = 200
    edges = pixels.canny(step)
    assert edges.sum(1).tolist() == [1] * 12 and edges[:, 5].all()
    weak = np.zeros((12, 12), np.uint8)
    weak[:, 6:] = 10  # a slope of 40: weak everywhere, so none stays
    assert not pixels.canny(weak).any()
    weak[0, 6:] = 200
    assert pixels.canny(weak).sum() > 1
    random = np.random.default_rng(2)
    image, points = face(random)
    mask, ring = pixels.hull_mask((48, 40), points), pixels.boundary_ring((48, 40), points)
    for y in range(48):
        for x in range(40):
            near = mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            assert ring[y, x] == (near.any() and not near.all())
    assert pixels.edge_density(image, points) == pytest.approx((pixels.canny(pixels.gray(image)) & ring).sum() / ring.sum())


def test_tensors():
    image = np.arange(96 * 96 * 3).reshape(96, 96, 3).astype(np.uint8)
    assert pixels.mouth_tensor([image], "face96")[0].transpose(1, 2, 0) == pytest.approx(image[48:] / 255)
    big = np.kron(image, np.ones((2, 2, 1), np.uint8))
    assert (pixels.resized(big, 96, 96) == image).all() and pixels.mouth_tensor([big], "mouth96").shape == (1, 3, 48, 96)
    assert (pixels.resized(np.full((5, 7, 1), 9), 11, 3) == 9).all() and pixels.normalized_tensor(big, 8).shape == (3, 8, 8)
    with pytest.raises(ValueError):
        pixels.mouth_tensor([image], "other")


def test_sound():
    t = np.arange(16_000) / 16_000
    tone = np.sin(2 * np.pi * 1000 * t)
    mel = sound.normalized_mel(tone)
    assert mel.shape == (80, 81) and mel.min() >= -4 and mel.max() <= 4
    bank = sound.mel_filters()
    assert set(mel[:, 40].argsort()[-2:]) & set(bank[50].argsort()[-1:])  # bin 50 is 1,000 Hz
    assert bank[:, 60].sum() * 20 == pytest.approx(1, rel=0.05)  # equal areas
    up = sound.at_rate(np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000), 8_000)
    assert len(up) == 16_000 and np.abs(up - np.sin(2 * np.pi * 440 * t))[200:-200].max() < 0.02
    assert (sound.at_rate(tone, 16_000) == tone).all() and len(sound.at_rate(np.ones(441), 44_100)) == 160
    assert sound.clean(np.array([[1, 3], [np.nan, 0]])).tolist() == [2, 0]

    short = np.random.default_rng(3).normal(size=700)
    rows = sound.log_filter_banks(short)
    assert rows.shape == (3, 26) and sound.log_filter_banks(np.zeros(0)).shape == (0, 26) and sound.log_filter_banks(np.zeros(5)).shape == (1, 26)
    loud = np.pad([short[0], *(short[i] - 0.97 * short[i - 1] for i in range(1, 700))], (0, 20))
    to_mel, to_hz = (lambda hz: 2595 * math.log10(1 + hz / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edge = [math.floor(513 * to_hz(to_mel(8000) * i / 27) / 16_000) for i in range(28)]
    for f in range(3):
        power = np.abs(np.fft.rfft(loud[160 * f : 160 * f + 400], 512)) ** 2 / 512
        for j in range(26):
            total = sum(power[i] * (i - edge[j]) / (edge[j + 1] - edge[j]) for i in range(edge[j], edge[j + 1]))
            total += sum(power[i] * (edge[j + 2] - i) / (edge[j + 2] - edge[j + 1]) for i in range(edge[j + 1], edge[j + 2]))
            assert rows[f, j] == pytest.approx(math.log(total))
    assert sound.stacked_rows(rows).shape == (1, 104) and (sound.stacked_rows(rows)[0, 78:] == 0).all()


class Runs:
    def __reduce__(self):
        return (print, ("ran",))


def test_npy():
    a = np.random.default_rng(4).random((2, 3, 5, 6))
    assert npy.face_batch(saved({"imgs": a})).shape == (2, 5, 6, 3) and npy.face_batch(saved(a * 255)).dtype == np.uint8
    assert (npy.face_batch(saved(np.full((1, 4, 4, 1), np.nan))) == 0).all() and npy.face_batch(saved(np.zeros((1, 7, 7, 4)))).shape[3] == 3
    assert npy.landmark_batch(saved({"pts": np.zeros((1, 2, 9, 2))}), 2).shape == (2, 9, 2) and npy.landmark_batch(saved(np.zeros((2, 2, 9))), 2).shape == (2, 9, 2)
    for bad in (saved({"x": a}), saved(a[0]), saved(np.zeros((1, 7, 7, 7)))):
        with pytest.raises(ValueError):
            npy.face_batch(bad)
    with pytest.raises(ValueError):
        npy.landmark_batch(saved(np.zeros((2, 9, 2))), 3)
    with pytest.raises(ValueError, match="not read"):
        npy.load(saved(np.array([Runs()], object)))
    assert npy.frame_list(saved(np.array([Runs()], object))) is None and npy.frame_list(b"junk") is None and npy.frame_list(None) is None
    assert len(npy.frame_list(saved(a))) == 2 and npy.frame_list(saved(np.array(5))) is None


def test_measures_of_slides(spark):
    random = np.random.default_rng(5)
    faces = [face(random) for _ in range(3)]
    images, points = saved(np.stack([f for f, _ in faces])), saved(np.stack([p / [40, 48] for _, p in faces]))
    rows = [("v", 0, images, points), ("v", 1, images, saved(np.zeros((1, 468, 2)))), ("v", 2, b"junk", points), ("v", 3, None, None), ("v", 4, saved(np.stack([faces[0][0]])), points), ("v", 5, images, saved(np.zeros(9))), ("v", 6, saved(np.zeros((2, 0, 4))), points), ("v", 7, images, saved(np.array(["a", "b"])))]
    got = media.frame_measures(spark.createDataFrame(rows, "video_id string, slide int, faces binary, landmarks binary"), ["video_id", "slide"])
    found = {(r["slide"], r["frame_idx"]): r for r in got.collect()}
    assert set(found) == {(0, 0), (0, 1), (0, 2), (1, 0)}
    for i, (image, p) in enumerate(faces):
        p = (p / [40, 48]).astype(np.float32) * np.float32([40, 48])
        r = found[0, i]
        assert (r["sharpness"], r["left"], r["right"], r["edges"]) == pytest.approx((pixels.sharpness(image, p), *pixels.texture(image, p), pixels.edge_density(image, p)))
    chunk = features.flicker(got, ["video_id"], ["slide", "frame_idx"], "sharpness").first()
    series = [found[k]["sharpness"] for k in sorted(found)]
    assert chunk["max_flicker"] == pytest.approx(np.abs(np.diff(series)).max()) and chunk["mean_value"] == pytest.approx(np.mean(series))


def test_features_of_sounds(spark):
    wave = [math.sin(i / 5) for i in range(1600)]
    rows = [(1, wave, 16_000), (2, None, 16_000), (3, [], 16_000), (4, [float("nan")] * 900, 8_000), (5, wave, None)]
    got = {r["k"]: r for r in media.sound_features(spark.createDataFrame(rows, "k int, samples array<double>, rate int"), ["k"]).collect()}
    assert np.array(got[1]["mel"]) == pytest.approx(sound.normalized_mel(np.array(wave))) and np.array(got[1]["banks"]) == pytest.approx(sound.stacked_rows(sound.log_filter_banks(np.array(wave))))
    assert got[2]["mel"] is None and got[5]["banks"] is None and got[3]["banks"] == [] and np.array(got[4]["mel"]).max() == -4
