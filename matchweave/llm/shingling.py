"""Sets of word shingles as sorted distinct hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 43


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; fewer words are one run, no word gives none."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hash_of(joined, SEED)], np.uint64)
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.array([hash_of(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64))


