"""Words of many texts at once as numpy arrays: hashes, offsets and rolling hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd base of the rolling hash and the multiplier of its finish.
BASE, FINISH = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of all texts, and each text's first place among them (and the end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    places = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), places[bounds - bounds[0]]


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of every word; each distinct word is hashed once."""
    from xxhash import xxh64_intdigest

    d = words.dictionary_encode()
    own = np.fromiter((xxh64_intdigest(w, seed) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return own[d.indices.to_numpy()] if len(own) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(FINISH)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words, by differences of prefix sums modulo 2**64."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up = np.full(n + 1, BASE, np.uint64)
    down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k neighbours, by doubling."""
    p, n = 1, len(x)
    if n < k:
        return x[:0]
    while 2 * p <= k:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - (k - p)], x[k - p :]) if p < k else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, all in one array."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
