"""Fast similarity sketching: every coordinate of a MinHash-like sketch filled in about ``n + t log t`` steps.

Round ``i < t`` throws every element into one hashed bin of ``t`` with the value ``i`` plus a hashed fraction; round
``t + b`` throws all elements into bin ``b``. A bin keeps its least value, and rounds end once no bin is empty, which the
last ``t`` rounds guarantee. Two sets agree in a coordinate with a probability equal to their Jaccard similarity, and the
number of agreements is as concentrated as that of ``t`` independent hashes.
"""

from __future__ import annotations

import math

import numpy as np

from graphloom.llm.common import mix

_BITS = 44  # of a value's fraction; above it 10 bits of round, above those the bin
_ROUNDS = 1 << 10


def choose_bands(threshold: float, miss: float = 1e-7) -> tuple[int, int]:
    """Rows and bands: about a quarter of pairs at the threshold agree in a band, and at most ``miss`` of them in no band."""
    rows = max(1, round(math.log(0.27) / math.log(threshold)))
    return rows, math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: ``t`` values, equal sets giving equal sketches."""
    if not 1 <= t <= _ROUNDS // 2:
        raise ValueError(f"a sketch has 1 to {_ROUNDS // 2} coordinates")
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    first, step = 0, max(1, min(t, math.ceil(1.3 * t * math.log(t + 1) / len(items))))
    while first < t and empty.any():
        i = np.arange(first, min(first + step, t), dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ mix(i + np.uint64(0x51ED270B)))
        b = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        _fill(out, empty, b, (i << np.uint64(_BITS)) | (mix(h) >> np.uint64(64 - _BITS)))
        first += step
    for b in np.flatnonzero(empty):  # rounds t to 2t - 1
        i = np.full(1, t + b, np.uint64)
        out[b] = (i[0] << np.uint64(_BITS)) | (mix(items ^ mix(i + np.uint64(0x51ED270B))).min() >> np.uint64(64 - _BITS))
    return out


def _fill(out: np.ndarray, empty: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
    key = np.sort(((b << np.uint64(_BITS + 10)) | value).ravel())
    at = (key >> np.uint64(_BITS + 10)).astype(np.int64)
    lead = np.ones(len(at), bool)
    lead[1:] = at[1:] != at[:-1]
    at, key = at[lead], key[lead]
    new = empty[at]
    out[at[new]] = key[new] & np.uint64((1 << (_BITS + 10)) - 1)
    empty[at[new]] = False


def band_keys(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    v = values[: rows * bands].reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(0x2545F491)
    for j in range(rows):
        key = mix(key ^ v[:, j])
    return key


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashed ``width``-word shingles of a text given as hashes of its words, sorted; fewer words: the whole sequence."""
    if not len(words):
        return words
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ words[i : len(words) - n + 1 + i])
    return np.unique(h)
