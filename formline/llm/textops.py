"""Byte-level helpers that run inside Arrow batches."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The word separators of the contracts, U+0020 and U+0009 to U+000D.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial prefix hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def folded(text: bytes) -> bytes:
    """A text in lower case, of all alphabets."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()], schema=schema
    )


@lru_cache(maxsize=4)
def symbol_table(seed: int = 7) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


#: Rows that are worked on at once where each takes several times its text.
DEALT = 1 << 8
_table: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, from one kept table, which is made anew for the next power of two if it is too short."""
    if not _table or len(_table[0]) < n:
        _table[:] = _powers(1 << max(12, (n - 1).bit_length()))
    return _table[0][:n], _table[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the order of hashes says nothing about the order of texts."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the sum of symbol[t] * BASE**t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) or 1)[0][: len(symbols)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:stop] that doesn't depend on the place."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start])


def word_bounds(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators. separator: bool[256]."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@lru_cache(maxsize=1)
def separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SEPARATORS)] = True
    return table


def union(intervals: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching half-open intervals, as an n x 2 array in order."""
    if not len(intervals):
        return np.zeros((0, 2), np.int64)
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    new = np.r_[True, intervals[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(intervals) - 1]
    return np.column_stack([intervals[new, 0], reach[last]])


def vocabulary_bytes(path: str, bound: int = 64 << 20) -> bytes:
    """A vocabulary file, read where the job is started and shipped with the tasks; its size is checked."""
    if os.path.getsize(path) > bound:
        raise ValueError(f"{path} is larger than {bound} bytes")
    with open(path, "rb") as f:
        return f.read()


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Batches) -> Batches:
    """The batches in slices of DEALT rows, so that a worker doesn't hold a whole batch of texts in several forms."""
    for b in batches:
        for k in range(0, b.num_rows, DEALT):
            yield b.slice(k, DEALT)


class Recent(dict):
    """What a worker remembers across tasks: entries used of late, in two generations of half of `bound` bytes each.

    Once the younger one is full it becomes the older one, whose entries move back when they are asked for again; what
    wasn't for a whole generation is forgotten.
    """

    def __init__(self, bound: int):
        super().__init__()
        self.older: dict = {}
        self.held, self.bound = 0, bound

    def keep(self, key, value, size: int) -> None:
        self[key] = value
        self.held += size
        if self.held > self.bound // 2:
            self.older, self.held = dict(self), 0
            self.clear()


Batches = Iterator[pa.RecordBatch]
