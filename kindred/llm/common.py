"""What the corpus operators share: the shared folder, words and their hashes.

A word is a run of bytes other than space and \\x09-\\x0D; ``bytes.split()`` splits at exactly
those, and no byte of a multi-byte UTF-8 character is one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from kindred.sources.shelf import Shelf, released, shared_folder

__all__ = ["Shelf", "WordHashes", "released", "shared_folder"]
WORD = r"[^\x20\x09-\x0D]+"
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash by word; forgets all words when it holds too many."""

    def __init__(self, most: int = 250_000, clean=None):
        super().__init__()
        self.most, self.clean = most, clean

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        kept = self.clean(word) if self.clean else word
        self[word] = value = (xxhash.xxh3_64_intdigest(kept) or 1) if kept else 0
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that sums of word hashes spread over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words; of the whole sequence where it has fewer; none without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        k = n
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out = out * STEP + words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def column_text(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that results of a batch of long texts stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
