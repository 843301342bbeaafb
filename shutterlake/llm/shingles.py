"""Word shingles of many texts at once: numpy over Arrow batches, used inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (the finalizer of a public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space), and each text's first one's place.

    Each distinct word of the batch is hashed once. There is one more place than
    texts; a null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    seen = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    # Nothing between the white space of an empty text: it has one empty piece.
    real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False).astype(bool)
    codes = coded.indices.to_numpy().astype(np.int64)
    if real.all():
        return seen[codes], at
    keep = real[codes]
    before = np.concatenate([[0], np.cumsum(keep)])
    return seen[codes[keep]], before[at]


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, in order, with repeats; a shorter text is one shingle."""
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1] - out[:-1], count) + np.arange(out[-1])
    size = np.repeat(np.minimum(n, k), count)
    h = np.zeros(out[-1], np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h = h * _P + np.where(j < size, padded[np.minimum(start + j, len(padded) - 1)], np.uint64(0))
    return mix(h + size.astype(np.uint64) * _Q), out


def sequence_ids(words: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each text's word sequence; none for a text without words."""
    n = np.diff(at)
    some = n > 0
    out: list[bytes | None] = [None] * len(n)
    if not some.any():
        return out
    place = (np.arange(len(words)) - np.repeat(at[:-1], n)).astype(np.uint64)
    starts = at[:-1][some]
    size = n[some].astype(np.uint64)
    a = mix(np.add.reduceat(mix(words + mix(place + _P)), starts) + size)
    b = mix(np.add.reduceat(mix(words * _Q + mix(place + _Q)), starts) + size)
    both = np.empty((len(a), 2), np.uint64)
    both[:, 0], both[:, 1] = a, b
    raw = both.tobytes()
    for i, row in enumerate(np.flatnonzero(some)):
        out[row] = raw[16 * i : 16 * i + 16]
    return out


def min_hashes(shingles: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(texts with shingles) x n minima under n random odd multipliers."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), n), np.uint64)
    if len(starts):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(shingles * a[i] + b[i], starts)
    return out


def slices(texts: pa.Array, most: int = 8_000_000):
    """Ranges of texts of about `most` bytes each, so that temporary arrays stay small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > most:
            yield first, i
            first, total = i, 0
        total += s
    if first < len(size):
        yield first, len(size)
