"""Five-word shingles of texts as 64-bit numbers, and numbers dealt to buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of other than the six ASCII white-space bytes, A-Z lower-cased."""
    return [] if text is None else text.encode().lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence is one where there are fewer words; none without words."""
    found = word_hashes(words(text))
    n = len(found)
    if not n:
        return found
    mixed = np.full(max(1, n - width + 1), min(n, width), np.uint64)
    for k in range(min(n, width)):
        mixed ^= mixed >> np.uint64(31)
        mixed = mixed * ODD + found[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * ODD)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key (under 2**31 of them): parts of the range of keys, so that sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets that occur in a sorted array, and where: a turn for each of them, however many there are in all."""
    if len(buckets):
        edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield int(buckets[lo]), slice(lo, hi)
