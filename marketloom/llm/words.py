"""Words and word shingles of byte texts, as numpy arrays, for use inside Spark tasks."""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words, and bytes of words, that a task remembers before it starts its dictionary anew.
MOST_WORDS, MOST_BYTES = 120_000, 8_000_000
#: Texts that are taken up together.
SLICE = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives memory that this process has freed back to the machine: workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at space and U+0009 to U+000D."""
    return text.lower().split() if text else []


class Index(dict):
    """Numbers words in order of appearance and keeps their 64-bit hashes."""

    def __init__(self) -> None:
        self.hashes, self.size = array("Q"), 0

    def __missing__(self, word: bytes | str) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self.size += len(word)
        return number

    @property
    def full(self) -> bool:
        return len(self) > MOST_WORDS or self.size > MOST_BYTES

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def shingle_sets(batches: Iterator[pa.RecordBatch], text: str, k: int = 5) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with its texts' sets of k-word shingle hashes, ascending; fewer words: one hash of them all; none: empty."""
    release()
    index = Index()
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        if index.full:
            index = Index()
        parts = [index.numbers(split(t)) for t in column_bytes(batch, text)]
        known = np.array(index.hashes, np.uint64)
        sets = []
        for part in parts:
            h = known[part]
            if len(h) >= k:
                s = h[: len(h) - k + 1].copy()
                for i in range(1, k):
                    s = s * _STEP + h[i : len(h) - k + 1 + i]
                sets.append(np.unique(mix(s)))
            elif len(h):
                s = np.uint64(len(h))
                with np.errstate(over="ignore"):
                    for x in h:
                        s = s * _STEP + x
                sets.append(mix(np.array([s], np.uint64)))
            else:
                sets.append(h)
        yield batch, sets
    del index
    release()


def pack(values: np.ndarray, width: int) -> bytes:
    """The low width bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()
