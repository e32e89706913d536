"""Perceptual hashes of decoded images: a DCT hash and a gradient hash, 64 bits each."""

from __future__ import annotations

import numpy as np


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (height, width, 3) RGB by the ITU-R 601 weights, rounded to whole levels."""
    return np.rint(pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def _weights(size: int, to: int) -> np.ndarray:
    """Rows of Lanczos-3 weights that resample ``size`` samples to ``to``, widened where it shrinks."""
    scale = max(1.0, size / to)
    centre = (np.arange(to)[:, None] + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    out = _weights(grey.shape[0], height) @ grey @ _weights(grey.shape[1], width).T
    return np.clip(np.rint(out), 0, 255)


def _dct(n: int) -> np.ndarray:
    """Unnormalised DCT-II as a matrix."""
    return 2 * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def _pack(bits: np.ndarray) -> int:
    """Bits row by row, the first the highest, as a signed 64-bit number."""
    n = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return n - (1 << 64) if n >> 63 else n


def phash(grey: np.ndarray) -> int:
    """Bits of the 8 x 8 lowest frequencies of the 32 x 32 image above their median."""
    d = _dct(32)
    low = (d @ resize(grey, 32, 32) @ d.T)[:8, :8]
    return _pack(low > np.median(low))


def dhash(grey: np.ndarray) -> int:
    """Bits of the 9 x 8 image: whether a pixel is brighter than the one left of it."""
    small = resize(grey, 9, 8)
    return _pack(small[:, 1:] > small[:, :-1])


def signature(pixels: np.ndarray) -> tuple[int, int]:
    grey = luma(pixels)
    return phash(grey), dhash(grey)
