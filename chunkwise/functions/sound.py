"""Measures of mono samples, NumPy only."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the mel spectrogram.
RATE, N_FFT, HOP, MELS, LOW_HZ, HIGH_HZ, FLOOR_DB, REF_DB, CLIP = 16_000, 800, 200, 80, 55, 7_600, -100.0, 20.0, 4.0


def clean(samples: np.ndarray) -> np.ndarray:
    """Mono samples, those that aren't finite as 0."""
    a = np.asarray(samples, np.float64)
    return np.nan_to_num(a.mean(1) if a.ndim == 2 else a, nan=0.0, posinf=0.0, neginf=0.0)


def at_rate(samples: np.ndarray, source: int, target: int = RATE, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Samples at another rate, by a sinc in a Hann window of ``zeros`` zero crossings on either side."""
    if source == target or not len(samples):
        return np.asarray(samples, np.float64)
    shared = math.gcd(source, target)
    old, new = source // shared, target // shared
    cut = min(old, new) * rolloff
    width = math.ceil(zeros * old / cut)
    reach = np.arange(-width, width + old)
    padded = np.pad(np.asarray(samples, np.float64), (width, width + old))
    steps = (len(padded) - len(reach)) // old + 1
    rows = np.lib.stride_tricks.sliding_window_view(padded, len(reach))[::old][:steps]
    t = np.clip((reach / old - np.arange(new)[:, None] / new) * cut, -zeros, zeros)
    kernel = np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2 * cut / old
    return (rows @ kernel.T).ravel()[: math.ceil(new * len(samples) / old)]


def _hz_of_mel(mel: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear up to 1,000 Hz (mel 15), then 27 mels for a factor of 6.4."""
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((mel - 15) / 27))


def _mel_of_hz(hz: float) -> float:
    return hz * 3 / 200 if hz < 1000 else 15 + 27 * math.log(hz / 1000, 6.4)


def mel_filters(bins: int = N_FFT // 2 + 1) -> np.ndarray:
    """(bins, MELS) triangles of equal area between neighbours on Slaney's scale."""
    corners = _hz_of_mel(np.linspace(_mel_of_hz(LOW_HZ), _mel_of_hz(HIGH_HZ), MELS + 2))
    hz = np.linspace(0, RATE // 2, bins)[:, None]
    up, down = (hz - corners[:-2]) / np.diff(corners)[:-1], (corners[2:] - hz) / np.diff(corners)[1:]
    return np.maximum(0, np.minimum(up, down)) * 2 / (corners[2:] - corners[:-2])


def normalized_mel(samples: np.ndarray) -> np.ndarray:
    """(MELS, frames) levels between -4 and 4, one frame every HOP samples; needs more than half a window of samples."""
    if len(samples) <= N_FFT // 2:
        return np.zeros((MELS, 0))
    padded = np.pad(np.asarray(samples, np.float64), N_FFT // 2, "reflect")
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    size = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP] * hann))
    level = 20 * np.log10(np.maximum(size @ mel_filters(), 10 ** (FLOOR_DB / 20))) - REF_DB
    return np.clip(2 * CLIP * (level - FLOOR_DB) / -FLOOR_DB - CLIP, -CLIP, CLIP).T


def log_filter_banks(samples: np.ndarray, rate: int = RATE, filters: int = 26, n_fft: int = 512) -> np.ndarray:
    """(frames, filters) logs of mel energies: emphasis 0.97, frames of 25 ms every 10 ms (the last filled with zeros), no window."""
    a = np.asarray(samples, np.float64)
    if not len(a):
        return np.zeros((0, filters))
    a = np.append(a[0], a[1:] - 0.97 * a[:-1])
    length, hop = int(0.025 * rate + 0.5), int(0.01 * rate + 0.5)
    frames = 1 + max(0, -(-(len(a) - length) // hop))
    a = np.pad(a, (0, (frames - 1) * hop + length - min(len(a), (frames - 1) * hop + length)))
    power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(a, length)[::hop][:frames], n_fft)) ** 2 / n_fft
    top = 2595 * math.log10(1 + rate / 2 / 700)
    corners = np.floor((n_fft + 1) * 700 * (10 ** (np.linspace(0, top, filters + 2) / 2595) - 1) / rate)
    k = np.arange(n_fft // 2 + 1)[:, None]
    low, mid, high = corners[:-2], corners[1:-1], corners[2:]
    up, down = (k - low) / np.maximum(mid - low, 1), (high - k) / np.maximum(high - mid, 1)
    bank = np.where((k >= low) & (k < mid), up, np.where((k >= mid) & (k < high), down, 0.0))
    energy = power @ bank
    return np.log(np.where(energy == 0, np.finfo(float).eps, energy))


def stacked_rows(rows: np.ndarray, by: int = 4) -> np.ndarray:
    """``by`` rows side by side; the last is filled with zeros."""
    return np.pad(rows, ((0, -len(rows) % by), (0, 0))).reshape(-1, by * rows.shape[1])
