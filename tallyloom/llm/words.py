"""Words, and hashes of words, of whole Arrow batches at once; numpy only, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyloom.llm.common import BASE, mixed

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte.
BYTES = _rng.integers(0, 2**64, 256, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are worked on at a time, unless one document is longer.
CHUNK = 1 << 20
_INVERSE = pow(BASE, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n or more; tables beyond four chunks are not kept."""
    if len(_tables.get("up", ())) >= n:
        return _tables["up"], _tables["down"]
    out = []
    for base in (BASE, _INVERSE):
        x = np.empty(max(n, CHUNK + 1), np.uint64)
        x[0], have, factor = 1, 1, base
        with np.errstate(over="ignore"):
            while have < len(x):
                m = min(have, len(x) - have)
                x[have : have + m] = x[:m] * np.uint64(factor)
                have, factor = have + m, factor * factor % 2**64
        out.append(x)
    if n <= 4 * CHUNK:
        _tables["up"], _tables["down"] = out
    return out[0], out[1]


@dataclass
class Chunk:
    """Some whole documents: their bytes, and the words in them."""

    first: int  # row of the first document in its batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # of documents in data, one more than documents
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    words: np.ndarray  # words before each document, one more than documents

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; lower: of the word with A-Z in lower case."""
        up, down = powers(len(self.data) + 1)
        values = BYTES[LOWER] if lower else BYTES
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(values[self.data] * up[: len(self.data)], out=sums[1:])
            return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def document(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.words))

    def runs(self, n: int) -> np.ndarray:
        """Words at which a run of n words of one document begins."""
        last = np.repeat(self.words[1:], np.diff(self.words))
        return np.flatnonzero(np.arange(len(last)) + n <= last)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def pieces(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most so many bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Chunk:
    """Find the words of documents that lie at the given offsets of data."""
    solid = ~BLANK[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    edges = offsets[1:][offsets[1:] > 0]
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return Chunk(first, data, offsets, starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets))


def chunks(column: pa.Array) -> Iterator[Chunk]:
    offsets, data = buffers(column)
    for i, j in pieces(offsets):
        yield split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)


def distinct_by_document(document: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, both sorted. document must be in ascending order."""
    if not len(values):
        return document, values
    order = np.lexsort((values, document))
    d, v = document[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return d[new], v[new]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
