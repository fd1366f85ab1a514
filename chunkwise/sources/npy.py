"""Bytes of ``.npy`` files as arrays, wrappers and layouts included.

Files of objects are pickles.  Only those of plain values and arrays are read;
any other class or function in one is an error, so no code of a file runs.
"""

from __future__ import annotations

import io
import pickle

import numpy as np

#: Names that a wrapped batch goes by, in the order in which they are looked for.
FACES = ["faces", "frames", "images", "imgs", "rgb", "bgr"]
LANDMARKS = ["landmarks", "lms", "pts", "points"]
CHANNELS = (1, 3, 4)
_ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype")} | {(f"numpy.{m}.{part}", name) for m in ("core", "_core") for part, name in (("multiarray", "_reconstruct"), ("multiarray", "scalar"), ("numeric", "_frombuffer"))}


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in _ALLOWED:
            raise ValueError(f"objects of {module}.{name} are not read")
        return super().find_class(module, name)


def load(content: bytes) -> object:
    """The array, or what a single object holds (a dict, a list)."""
    source = io.BytesIO(content)
    version = np.lib.format.read_magic(source)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    if not kind.hasobject:
        return np.load(io.BytesIO(content), allow_pickle=False)
    found = _Plain(source).load()
    return found.item() if shape == () else found


def _unwrapped(found: object, names: list[str]) -> np.ndarray:
    if isinstance(found, dict):
        name = next((n for n in names if n in found), None)
        if name is None:
            raise ValueError(f"none of {names} in {sorted(map(str, found))}")
        found = found[name]
    return np.asarray(found)


def levels(a: np.ndarray) -> np.ndarray:
    """uint8; floats between 0 and 1 as a whole are shares of 255, NaN is 0."""
    if np.issubdtype(a.dtype, np.floating):
        finite = a[np.isfinite(a)]
        a = np.nan_to_num(a * (255.0 if finite.size and finite.min() >= 0 and finite.max() <= 1 else 1.0), nan=0.0, posinf=255.0, neginf=0.0)
    return np.clip(a, 0, 255).astype(np.uint8)


def face_batch(content: bytes) -> np.ndarray:
    """(frames, h, w, 3) uint8 in BGR order from channels last or first, one, three or four of them; ValueError else."""
    a = _unwrapped(load(content), FACES)
    if a.ndim != 4:
        raise ValueError(f"faces have four dimensions, not {a.shape}")
    if a.shape[3] not in CHANNELS:
        if a.shape[1] not in CHANNELS:
            raise ValueError(f"no dimension of {a.shape} is one of channels")
        a = a.transpose(0, 2, 3, 1)
    a = levels(a)
    return np.repeat(a, 3, axis=3) if a.shape[3] == 1 else a[..., :3]


def landmark_batch(content: bytes, frames: int) -> np.ndarray:
    """(frames, points, 2) floats from coordinates last or first, also of one face in four dimensions; ValueError else."""
    a = _unwrapped(load(content), LANDMARKS)
    if a.ndim == 4 and a.shape[3] == 2 and 1 in a.shape[:2]:
        a = a[0] if a.shape[0] == 1 else a[:, 0]
    if a.ndim != 3 or 2 not in (a.shape[2], a.shape[1]):
        raise ValueError(f"no landmarks of two coordinates in {a.shape}")
    a = a if a.shape[2] == 2 else a.transpose(0, 2, 1)
    if len(a) != frames:
        raise ValueError(f"{len(a)} landmarks of {frames} faces")
    return a.astype(np.float32)


def frame_list(content: bytes | None) -> list[np.ndarray] | None:
    """The items of what a file holds; None where it can't be read or is neither an array nor a list."""
    if content is None:
        return None
    try:
        found = load(content)
    except (ValueError, EOFError, OSError, pickle.UnpicklingError, AttributeError, TypeError, IndexError, KeyError):
        return None
    return [np.asarray(x) for x in found] if isinstance(found, list | tuple) or isinstance(found, np.ndarray) and found.ndim else None
