"""Measures of single images, NumPy only: images are (h, w) or (h, w, 3) in BGR order, landmarks (n, 2 or more) in pixels.

Masks hold the pixels inside a hull or on its edges; a drawing library also
marks pixels that an edge only touches, so values may differ in a hull's rim.
"""

from __future__ import annotations

import numpy as np

#: Points of the cheeks and of the face's sides among the landmarks, and the fewest landmarks of a face.
CHEEK_LEFT, CHEEK_RIGHT, SIDE_LEFT, SIDE_RIGHT, LANDMARKS = 117, 346, 234, 454, 468
#: Canny's thresholds, and the share of the width that the boundary ring's window has.
CANNY_LOW, CANNY_HIGH, RING_SHARE = 20, 60, 0.06


def gray(image: np.ndarray, unit: bool = False) -> np.ndarray:
    """uint8 levels; floats are cut to 0..255, after a factor of 255 where ``unit``.  Weights as fixed-point numbers of 15 bits."""
    if image.dtype != np.uint8:
        scaled = image * 255.0 if unit and np.issubdtype(image.dtype, np.floating) else image
        image = np.clip(np.nan_to_num(scaled), 0, 255).astype(np.uint8)
    if image.ndim == 2:
        return image
    return ((image[..., :3].astype(np.int64) @ np.array([3735, 19235, 9798]) + (1 << 14)) >> 15).astype(np.uint8)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of integer points, in one turning direction."""
    ordered = np.unique(np.asarray(points, np.int64), axis=0)
    if len(ordered) < 3:
        return ordered

    def chain(some) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(ordered.tolist()) + chain(ordered[::-1].tolist()))


def hull_mask(shape: tuple[int, int], landmarks: np.ndarray) -> np.ndarray:
    """Pixels in the hull of the landmarks, whose fractions are cut off."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    corners = convex_hull(landmarks[:, :2].astype(np.int32))
    (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
    inside = (xs >= x0) & (xs <= x1) & (ys >= y0) & (ys <= y1)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (ys - a[1]) >= (b[1] - a[1]) * (xs - a[0])
    return inside


def _face(landmarks: np.ndarray | None) -> bool:
    return landmarks is not None and len(landmarks) >= LANDMARKS and bool(np.isfinite(landmarks[:, :2]).all())


def sharpness(image: np.ndarray, landmarks: np.ndarray | None) -> float:
    """Variance of the Laplacian (mirrored edges) in the face's hull; 0 without a face."""
    if not _face(landmarks):
        return 0.0
    g = np.pad(gray(image, unit=True).astype(float), 1, "reflect" if min(image.shape[:2]) > 1 else "edge")
    laplacian = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    inside = laplacian[hull_mask(laplacian.shape, landmarks)]
    return float(inside.var()) if inside.size else 0.0


def contrast(patch: np.ndarray) -> float:
    """Mean contrast of the normalised co-occurrences at distances 1 and 3 in four directions.

    The contrast of a normalised table is the mean squared difference of its pairs, so no table is filled.
    """
    p, (h, w) = patch.astype(float), patch.shape
    found = []
    for d in (1, 3):
        slant = round(d * np.sqrt(0.5))
        for dy, dx in ((0, d), (slant, slant), (d, 0), (slant, -slant)):
            a, b = p[: h - dy, max(0, -dx) : w - max(0, dx)], p[dy:, max(0, dx) : w + min(0, dx)]
            found.append(float(((a - b) ** 2).mean()) if a.size else 0.0)
    return float(np.mean(found))


def texture(image: np.ndarray, landmarks: np.ndarray | None) -> tuple[float, float]:
    """Contrast of the left and the right cheek; 0 without a face, for one under 10 pixels wide, and for patches under 5 pixels."""
    if not image.size or not _face(landmarks):
        return 0.0, 0.0
    g = gray(image)
    width = float(np.linalg.norm(landmarks[SIDE_RIGHT, :2] - landmarks[SIDE_LEFT, :2]))
    if width < 10:
        return 0.0, 0.0
    half = max(10, int(width * 0.15)) // 2
    out = []
    for point in (CHEEK_LEFT, CHEEK_RIGHT):
        x, y = (int(np.round(v)) for v in landmarks[point, :2])
        patch = g[max(0, y - half) : max(0, y + half), max(0, x - half) : max(0, x + half)]
        out.append(contrast(patch) if min(patch.shape) >= 5 else 0.0)
    return out[0], out[1]


def _window_counts(mask: np.ndarray, k: int) -> np.ndarray:
    """How many pixels of the k x k window around each pixel are set; the window starts k // 2 before it."""
    sums = np.pad(mask.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    lo, hi = (lambda n: np.maximum(np.arange(n) - k // 2, 0)), (lambda n: np.minimum(np.arange(n) - k // 2 + k, n))
    (h, w) = mask.shape
    return sums[np.ix_(hi(h), hi(w))] - sums[np.ix_(lo(h), hi(w))] - sums[np.ix_(hi(h), lo(w))] + sums[np.ix_(lo(h), lo(w))]


def boundary_ring(shape: tuple[int, int], landmarks: np.ndarray) -> np.ndarray:
    """The hull widened without the hull narrowed, by a square window of 6 % of the image's width (3 pixels at least)."""
    mask = hull_mask(shape, landmarks)
    k = max(3, int(shape[1] * RING_SHARE))
    some = _window_counts(mask, k)
    return (some > 0) & (some < _window_counts(np.ones_like(mask), k))


def canny(g: np.ndarray, low: float = CANNY_LOW, high: float = CANNY_HIGH) -> np.ndarray:
    """Edges by Canny's rule: Sobel slopes (repeated edges), thinned across the slope, and weak edges only next to strong ones."""
    p = np.pad(g.astype(np.int64), 1, "edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    steep = np.tan(np.pi / 8)
    flat, tall = np.abs(dy) < steep * np.abs(dx), np.abs(dy) > np.abs(dx) / steep
    rising = (dx < 0) != (dy < 0)
    thin = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(tall, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(rising, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    weak = thin & (size > low)
    edges = weak & (size > high)
    while True:
        grown = weak & (_window_counts(edges, 3) > 0)
        if (grown == edges).all():
            return edges
        edges = grown


def edge_density(image: np.ndarray, landmarks: np.ndarray | None) -> float:
    """Share of the boundary ring's pixels that are edges; 0 without a face or a ring."""
    if not _face(landmarks):
        return 0.0
    g = gray(image)
    ring = boundary_ring(g.shape, landmarks)
    return float((canny(g) & ring).sum() / ring.sum()) if ring.any() else 0.0


def _shares(source: int, target: int) -> np.ndarray:
    """(target, source) weights of a resize: covered lengths where it shrinks, linear between centres where it grows."""
    step = source / target
    if step >= 1:
        edge = np.arange(target + 1) * step
        cover = np.minimum(edge[1:, None], np.arange(1, source + 1)) - np.maximum(edge[:-1, None], np.arange(source))
        return np.maximum(cover, 0) / step
    place = np.clip((np.arange(target) + 0.5) * step - 0.5, 0, source - 1)
    return np.maximum(0, 1 - np.abs(place[:, None] - np.arange(source)))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """uint8 image of another size, by areas."""
    out = np.einsum("yh,hwc,xw->yxc", _shares(image.shape[0], height), image.astype(float), _shares(image.shape[1], width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mouth_tensor(frames: list[np.ndarray], layout: str, size: int = 96) -> np.ndarray:
    """(frames, channels, size / 2, size) in 0..1: ``mouth96`` resized as a whole, of ``face96`` the lower half."""
    if layout not in ("face96", "mouth96"):
        raise ValueError(f"unknown layout of frames: {layout}")
    half = size // 2
    views = [resized(f, size, size)[half:] if layout == "face96" else resized(f, half, size) for f in frames]
    return np.stack(views).transpose(0, 3, 1, 2).astype(np.float32) / 255


def normalized_tensor(image: np.ndarray, size: int, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """(3, size, size) of an RGB image, in 0..1, less ``mean``, over ``std``."""
    return ((resized(image, size, size).astype(np.float32) / 255 - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)
