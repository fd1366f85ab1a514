"""Landmark geometry: arrays of (x, y) arrays, null where a point was not found.  All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def found_points(points) -> Column:
    """The points whose coordinates are both finite numbers."""
    return F.filter(col(points), lambda p: p.isNotNull() & _finite(p[0]) & _finite(p[1]))


def bounding_box(points) -> Column:
    """struct(x0, y0, x1, y1) of the points found; null if there are none."""
    ok = found_points(points)
    xs, ys = F.transform(ok, lambda p: p[0]), F.transform(ok, lambda p: p[1])
    return F.when(F.size(ok) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def centered(points) -> Column:
    """Points relative to their box's centre, in widths of the box (at least 1e-6); null without points."""
    box = bounding_box(points)
    w = F.greatest(box["x1"] - box["x0"], F.lit(1e-6))
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return F.when(box.isNotNull(), F.transform(col(points), lambda p: F.array((p[0] - cx) / w, (p[1] - cy) / w)))


def center(points) -> Column:
    """Mean of the points found; null without points."""
    ok = found_points(points)
    mean = lambda i: F.aggregate(ok, F.lit(0.0), lambda s, p: s + p[i]) / F.size(ok)
    return F.when(F.size(ok) > 0, F.array(mean(0), mean(1)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))


def eye_aspect_ratio(eye) -> Column:
    """Openness of an eye of six points: both heights over twice the width."""
    p = lambda i: F.get(col(eye), F.lit(i))
    return (distance(p(1), p(5)) + distance(p(2), p(4))) / (F.lit(2.0) * distance(p(0), p(3)) + F.lit(1e-6))


def mean_displacement(points, before) -> Column:
    """Mean distance between two frames' points, over the points found in both; null if there are none."""
    moved = F.filter(F.zip_with(col(points), col(before), lambda a, b: distance(a, b)), _finite)
    return F.when(F.size(moved) > 0, F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) / F.size(moved))


def mapped(points, scale_x, scale_y, shift_x=0.0, shift_y=0.0) -> Column:
    """Points in other coordinates: each times a scale, plus a shift."""
    lit = lambda v: F.lit(v) if isinstance(v, int | float) else col(v)
    return F.transform(col(points), lambda p: F.array(p[0] * lit(scale_x) + lit(shift_x), p[1] * lit(scale_y) + lit(shift_y)))


def affine(point, matrix: list[list[float]]) -> Column:
    p = col(point)
    return F.array(*[p[0] * F.lit(float(a)) + p[1] * F.lit(float(b)) + F.lit(float(c)) for a, b, c in matrix])


def widened(box, margin: float, width, height) -> Column:
    """A box made larger by a share of its size on each side, within the image."""
    b = col(box)
    dx, dy = (b["x1"] - b["x0"]) * F.lit(margin), (b["y1"] - b["y0"]) * F.lit(margin)
    return F.struct(F.greatest(F.lit(0.0), b["x0"] - dx).alias("x0"), F.greatest(F.lit(0.0), b["y0"] - dy).alias("y0"), F.least(col(width).cast("double"), b["x1"] + dx).alias("x1"), F.least(col(height).cast("double"), b["y1"] + dy).alias("y1"))


def overlapping_least(boxes) -> Column:
    """Whether two of the boxes (x0, y0, x1, y1) overlap in less than 0.3 of their union: two faces in a frame."""
    from .scalar import iou

    fields = ("x0", "y0", "x1", "y1")
    pair = lambda a, b: iou([a[f] for f in fields], [b[f] for f in fields]) < 0.3
    return F.exists(col(boxes), lambda a: F.exists(col(boxes), lambda b: (a != b) & pair(a, b)))


def chosen_face(boxes, before_area) -> Column:
    """The box whose area is nearest to the one before; the largest without one; the first of equals."""
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    gap = lambda b: F.when(col(before_area).isNull(), -area(b)).otherwise(F.abs(area(b) - col(before_area)))
    best = F.array_min(F.transform(col(boxes), lambda b, i: F.struct(gap(b).alias("gap"), i.alias("i"))))
    return F.get(col(boxes), best["i"])


def yaw_ratio(nose, left, right) -> Column:
    """Shorter of the nose's distances to the face's sides over the longer: small for a turned head."""
    a, b = distance(col(nose), col(left)), distance(col(nose), col(right))
    return F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), F.lit(0.0))


def pixel_values(values) -> Column:
    """Numbers as pixels 0..255: values in 0..1 are scaled, missing ones are 0, infinite ones 255."""
    v = col(values)
    clean = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))))
    unit = F.forall(v, lambda x: x.isNull() | F.isnan(x) | ((x >= 0) & (x <= 1)))
    return F.transform(clean, lambda x: F.floor(F.when(unit, x * 255).otherwise(x)).cast("int"))


def kinematics(open_left, open_right, mouth) -> list[Column]:
    """Population variances of blinking and of the mouth's opening over frames, as aggregates."""
    return [F.coalesce(F.var_pop((col(open_left) + col(open_right)) / 2), F.lit(0.0)).alias("blinking_variance"), F.coalesce(F.var_pop(col(mouth)), F.lit(0.0)).alias("mouth_movement_variance")]


def cropped_samples(samples, first_slide, frames, rate, fps: float = 25.0, length: float = 0.5) -> Column:
    """The audio samples of a chunk's kept frames."""
    n = F.size(col(samples))
    start = F.least(F.greatest((col(first_slide) * length * col(rate)).cast("int"), F.lit(0)), n)
    end = F.least(F.greatest(((col(first_slide) * length + col(frames) / F.lit(fps)) * col(rate)).cast("int"), start), n)
    return F.slice(col(samples), start + 1, end - start)


def audio_status(samples, rate, least: float = 0.1) -> Column:
    """missing_audio, too_short or ok."""
    return F.when(col(samples).isNull(), "missing_audio").when(F.size(col(samples)) < F.lit(least) * col(rate), "too_short").otherwise("ok")
