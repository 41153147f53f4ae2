"""Harmonic packing: lengths fall in reciprocal-capacity classes; each class's bins take a fixed number of pieces, worker by worker."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import give_back, narrow_batches, stored
from tallyloom.llm.words import chunks, ragged

CAPACITY = 2048
#: Rests below this are not cut; a bin of them wastes less than one of them.
TAIL = 64
#: Tasks whose open bins meet in one task of the next level.
FAN_IN = 32
#: Words that are held with their ids, at most; words that the tokenizer gets at a time (it makes some 1 KB of each).
MOST_WORDS, WORDS = 500_000, 2_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordIds:
    """Token ids of words under a tokenizer that never joins text across white space, kept by 64-bit word hash.

    Equal hashes of different words would mix up their ids; among ten million words the chance is 3e-6.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core; threads would keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.old = self.new = pd.Index(np.empty(0, np.uint64))  # new: those of late, so that the large table is rarely rebuilt

    def slots(self, hashes: np.ndarray, word: Callable[[int], bytes]) -> np.ndarray:
        """Where the ids of each word lie; word(k) gives the bytes of the k-th."""
        codes, unique = pd.factorize(hashes)
        at = self.old.get_indexer(unique)
        missing = np.flatnonzero(at < 0)
        late = self.new.get_indexer(unique[missing])
        at[missing[late >= 0]] = len(self.old) + late[late >= 0]
        missing = missing[late < 0]
        if len(missing):
            have = len(self.old) + len(self.new)
            if have and have + len(missing) > self.most:
                self.clear()
                return self.slots(hashes, word)
            firsts = np.empty(len(unique), np.int64)
            firsts[codes[::-1]] = np.arange(len(codes))[::-1]
            ids, counts = [self.ids], []
            for i in range(0, len(missing), WORDS):
                texts = [word(k).decode("utf-8", "replace") for k in firsts[missing[i : i + WORDS]]]
                found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                counts += map(len, found)
                ids.append(np.array([t for x in found for t in x], np.uint32))
            at[missing] = have + np.arange(len(missing))
            self.new = self.new.append(pd.Index(unique[missing]))
            if len(self.new) > 100_000:
                self.old, self.new = self.old.append(self.new), self.new[:0]
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts, dtype=np.int64)])
            self.ids = np.concatenate(ids)
        return at[codes]


_cached: dict[str, WordIds] = {}


def document_ids(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row and token ids (uint32) of each text of a column; null counts as empty."""
    words = _cached.setdefault(path, WordIds(path))
    for c in chunks(column):
        text = c.data.tobytes()
        slot = words.slots(c.hashes(), lambda k, c=c, text=text: text[c.starts[k] : c.ends[k]])
        begin, length = words.at[slot], words.at[slot + 1] - words.at[slot]
        ids = words.ids[ragged(begin, length)]
        bounds = np.concatenate([[0], np.cumsum(length)])[c.words]
        for k in range(len(c.offsets) - 1):
            yield c.first + k, ids[bounds[k] : bounds[k + 1]]


def forget() -> None:
    """Let go of all words, so that a worker that waits for its next task holds the tokenizer only."""
    for words in _cached.values():
        words.clear()
    give_back()


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces of a document of n ids: whole sequences, then halves of them (1/2, 1/4, ...), then a rest below tail."""
    out = [capacity] * (n // capacity)
    n, part = n % capacity, capacity
    while part > tail and n:
        part //= 2
        if n >= part:
            out.append(part)
            n -= part
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one worker, by length. A bin of pieces of length n takes capacity // n of them and is emitted when full."""

    def __init__(self, level: int, worker: int, capacity: int):
        self.base, self.used, self.capacity, self.open, self.out = (level << 56) | (worker << 32), 0, capacity, {}, []

    def put(self, piece: tuple) -> None:
        n = piece[2]
        held = self.open.setdefault(n, [])
        held.append(piece)
        if len(held) >= self.capacity // n:
            self.close(held)
            self.open[n] = []

    def close(self, held: list[tuple]) -> None:
        at = 0
        for p in held:
            self.out.append((*p[:5], self.base + self.used, at))
            at += p[2]
        self.used += 1

    def rest(self, last: bool) -> None:
        """What is left in open bins: for the next level, or first-fit in descending length on the last."""
        left = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        if not last:
            self.out += [(*p[:5], None, None) for p in left]
            return
        bins: list[list] = []
        full = 0
        for p in left:
            k = next((k for k in range(full, len(bins)) if bins[k][0] >= p[2]), None)
            if k is None:
                bins.append([self.capacity, []])
                k = len(bins) - 1
            bins[k][0] -= p[2]
            bins[k][1].append(p)
            while full < len(bins) and bins[full][0] == 0:
                full += 1
        for _, held in bins:
            self.close(held)

    def batch(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.out) > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.out, strict=True)], list(_FIELDS))
            self.out = []


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are cut into capacity, capacity/2, ... and a rest below TAIL, so that bins of 1, 2, 4, ... pieces are
    full without padding. Each worker fills bins on its own and holds only what is open: fewer than capacity // n pieces of
    each of some 70 lengths n. Open bins meet in FAN_IN times fewer tasks, level by level; the last places what is left
    first-fit. So padding doesn't grow with the workers, and no task sees more than FAN_IN workers' open bins.

    Nulls: a null text has the end id alone; a null id stays null. Repeated rows are packed each. Other columns are ignored.
    Empty table: no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(0, TaskContext.get().partitionId(), capacity)
        for b in batches:
            ids = b.column(0).to_pylist()
            for row, tokens in document_ids(b.column(1), tokenizer_path):
                raw = np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes()
                at = 0
                for n in cuts(len(raw) // 4, capacity):
                    bins.put((ids[row], at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(raw) // 4))
                    at += n
                yield from bins.batch(20_000)
        bins.rest(False)
        yield from bins.batch()
        forget()

    def again(level: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = Bins(level, TaskContext.get().partitionId(), capacity)
            for b in batches:
                for piece in zip(*(x.to_pylist() for x in b.columns[:5]), strict=True):
                    bins.put(piece)
                yield from bins.batch(20_000)
            bins.rest(last)
            yield from bins.batch()
            give_back()

        return run

    narrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    at = stored(texts.mapInArrow(first, _PIECE))
    out, level, workers = at.where("sequence_id is not null"), 1, max(1, texts.rdd.getNumPartitions())
    while True:
        workers = -(-workers // FAN_IN)
        at = stored(at.where("sequence_id is null").repartition(workers, F.xxhash64("doc_id", "start")).mapInArrow(again(level, workers == 1), _PIECE))
        out = out.unionByName(at.where("sequence_id is not null"))
        if workers == 1:
            return out.select(*T._parse_datatype_string(_PIECE).names)
        level += 1
