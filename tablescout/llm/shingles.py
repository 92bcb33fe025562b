"""Hashed word shingles of whole texts, as numpy arrays.

Words are stretches without ASCII white space, A-Z lower-cased. Words and shingles are 64-bit hashes of
their bytes and order; two different shingles of a corpus meet with a chance of about 2^-64 a pair."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1)
_NEAR = _draw.integers(0, 2**63, 1024, np.uint64) * _U(2) + _U(1)
_FAR = _draw.integers(0, 2**63, 1024, np.uint64) * _U(2) + _U(1)
_PLACE = _draw.integers(0, 2**63, 64, np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    solid = ~_SEPARATOR[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) != 1
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    values = _BYTE[_LOWER[raw[at]]] * _NEAR[place & 1023] * _FAR[(place >> 10) & 1023]
    values = _mix(values)
    return _mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words the whole sequence is one; without words empty."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total += h[i : len(h) - width + 1 + i] * _PLACE[i % 64]
    return np.unique(_mix(total))


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)
