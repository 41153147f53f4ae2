"""Suffix-array dedup: front-coded sorted suffix runs, merged by a loser tree that never compares known prefixes again."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_stored, stored
from tallyloom.llm.regions import Scheme, contents, merged, regions, with_keys

#: Bytes of a gram that names windows.
GRAM = 16
#: Suffixes of a run, and of one of its blocks.
RUN, BLOCK = 50_000, 512
#: Distinct regions that one merge should hold at most, on average.
PART = 20_000
#: Distinct regions that are searched together; a group of one gram is not split.
TOGETHER = 4096

_HEAD = struct.Struct("<HHHI")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which the first `known` bytes are known."""
    most = min(len(a), len(b))
    i, step = known, 32
    while i < most:
        j = min(i + step, most)
        if a[i:j] == b[i:j]:
            i, step = j, step * 2
        elif j - i == 1:
            return i
        else:
            most, step = j, max(1, (j - i) // 2)
            if a[i : i + step] == b[i : i + step]:
                i += step
    return i


def front_coded(records: list[tuple[bytes, bytes, bytes, int]]) -> Iterator[bytes]:
    """Blocks of a sorted run of (suffix, reversed left context, 16-byte name, copies): each suffix less what it shares with the last."""
    last = b""
    for at in range(0, len(records), BLOCK):
        out = []
        for key, left, tid, n in records[at : at + BLOCK]:
            shared = common_prefix(last, key)
            out += [_HEAD.pack(shared, len(key) - shared, len(left), min(n, 2**32 - 1)), key[shared:], left, tid]
            last = key
        yield b"".join(out)


def decoded(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, bytes, int]]:
    """(prefix shared with the last, suffix, reversed left context, name, copies) of a run."""
    last = b""
    for data in blocks:
        at = 0
        while at < len(data):
            shared, rest, left, n = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            last = last[:shared] + data[at : at + rest]
            at += rest
            yield shared, last, data[at : at + left], data[at + left : at + left + 16], n
            at += left + 16


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The records of all runs in order of suffix; the first item of each is the prefix it shares with the one before."""
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # with the last record that came out

    def winner(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x[1], y[1], shared[a])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * size
    level = list(range(size))
    base = size
    while len(level) > 1:
        base //= 2
        won = []
        for k in range(0, len(level), 2):
            w, lost = winner(level[k], level[k + 1])
            losers[base + k // 2] = lost
            won.append(w)
        level = won
    top = level[0]
    while heads[top] is not None:
        yield (shared[top], *heads[top][1:])
        following = next(runs[top], None)
        heads[top] = following
        shared[top] = following[0] if following else 0
        node = (top + size) // 2
        while node:
            top, losers[node] = winner(top, losers[node])
            node //= 2


def covered(records: list[tuple], window: int) -> Iterator[tuple[bytes, int, int]]:
    """Of distinct regions of whole groups of one gram, in order of the suffix from it on (shared, suffix, reversed left, name, copies;
    shared and suffix with the gram's 8 bytes before): name and ranges (first, last) of the windows whose bytes occur in another too.

    A window is so many bytes before its gram and the rest from it on. Regions that share the rest are an interval of the suffixes,
    those that share what is before one of the left contexts, and a window repeats if two regions meet in both. So one pass over
    all regions settles each length of what is before, however many regions a gram has: no region is held against the others.
    """
    n = len(records)
    if n < 2:
        return
    right = np.array([r[0] for r in records]) - 8
    group = np.cumsum(right < 0)
    left = [r[2] for r in records]
    order = sorted(range(n), key=lambda k: (group[k], left[k]))
    before = np.array([-1] + [common_prefix(left[x], left[y]) if group[x] == group[y] else -1 for x, y in pairwise(order)])
    ends = lambda lcp, least: np.cumsum(lcp < least)  # noqa: E731  numbers of classes, from 0 or 1 on
    sizes = np.array([len(x) for x in left])
    was, since = np.zeros(n, bool), np.zeros(n, int)
    longest = int(sizes.max())
    for a in range(min(longest, window) + 2):
        hit = np.zeros(n, bool)
        if a <= min(longest, window):
            rest, own = ends(right, window - a), np.empty(n, int)
            own[order] = ends(before, a)
            pick = np.flatnonzero((np.bincount(rest)[rest] > 1) & (np.bincount(own)[own] > 1))
            both = rest[pick] * (n + 1) + own[pick]
            at = np.argsort(both)
            same = both[at[1:]] == both[at[:-1]]
            hit[pick[at[1:][same]]] = True
            hit[pick[at[:-1][same]]] = True
        since[hit & ~was] = a
        for k in np.flatnonzero(was & ~hit).tolist():
            yield records[k][3], int(sizes[k]) - a + 1, int(sizes[k] - since[k])
        was = hit


def repeated_bytes(docs: DataFrame, window: int) -> DataFrame:
    """docs: key, text. key and spans (arrays of start and end byte) covered by strings of `window` bytes that occur elsewhere too."""
    scheme = Scheme(True, window, min(GRAM, window))
    found = regions(docs, scheme)
    once = found.groupBy("m", "tid").agg(F.min(F.struct("key", "start")).alias("f"), F.first("length").alias("length"), F.first("anchor").alias("anchor"), F.count("*").alias("n"))
    once = stored(once.withColumn("alone", F.count("*").over(Window.partitionBy("m")) == 1))  # no other content has its gram
    meet = once.where("not alone")
    parts = max(1, -(-meet.count() // PART))
    distinct = contents(docs, meet.select("m", "tid", "f.key", "f.start", "length", "anchor"), scheme)
    several = once.where("n > 1").select("m", "tid", F.lit(0).alias("i"), (F.col("length") - window).alias("e"))

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        run, size = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, records in held.items():
                records.sort()
                blocks = list(front_coded(records))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array([TaskContext.get().partitionId() << 32 | run] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["part", "run", "block", "data"])
            held.clear()

        for b in batches:
            for m, tid, content, anchor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[m % parts].append((struct.pack(">q", m) + content[anchor:], content[:anchor][::-1], struct.pack(">qq", m, tid), 1))
                size += 1
                if size >= RUN:
                    yield from flush()
                    run, size = run + 1, 0
        yield from flush()

    def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for b in batches:
            for part, run, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[part][run].append((block, data))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            rows = [(*struct.unpack(">qq", name), i, e) for name, i, e in out]
            out.clear()
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["m", "tid", "i", "e"])

        for part in sorted(held):
            groups: list[tuple] = []
            runs = [decoded([data for _, data in sorted(blocks)]) for _, blocks in sorted(held.pop(part).items())]
            for record in merge(runs):
                if len(groups) >= TOGETHER and record[0] < 8:
                    out += covered(groups, window)
                    groups = []
                    if len(out) > 20_000:
                        yield batch()
                groups.append(record)
            out += covered(groups, window)
        yield batch()

    runs = distinct.select("m", "tid", "content", "anchor").mapInArrow(sorted_runs, "part int, run long, block int, data binary")
    ranges = runs.repartition(parts, "part").mapInArrow(merged_runs, "m long, tid long, i int, e int").unionByName(several)
    span = F.struct((F.col("start") + F.col("i")).alias("s"), (F.col("start") + F.col("e") + window).alias("e"))
    out = stored(found.select("m", "tid", "key", "start").join(ranges, ["m", "tid"]).groupBy("key").agg(F.collect_set(span).alias("spans")))
    drop_stored(found, once)
    return out


def remove_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text, spans): key, bytes removed, maximal runs of them, and the bytes that are left."""
    for b in batches:
        removed, runs, left = [], [], []
        for text, spans in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            gone = merged([(x["s"], x["e"]) for x in spans])
            at, parts = 0, []
            for i, j in gone:
                parts.append(text[at:i])
                at = j
            left.append(b"".join([*parts, text[at:]]))
            removed.append(len(text) - len(left[-1]))
            runs.append(len(gone))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary())], ["key", "n_removed", "n_spans", "left"])


def dedup_suffixes(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, and kept (binary: the bytes left) or, with digest, kept_sha256 of it.

    A byte goes if a string of `window` bytes covers it that starts anywhere else too, all occurrences alike; matches never
    cross rows and are judged on the input. Suffixes from the grams of distinct regions (see regions.py) are sorted into
    front-coded runs where they are found, exchanged, and merged with their common prefixes; what neighbours share on both
    sides of the gram gives the windows that repeat. Regions with equal content are counted before, and meet only as one.

    Nulls: a null text is empty. Rows that repeat an id, or have none, are separate texts. Other columns are ignored. Empty
    table: no rows.
    """
    texts, ids = with_keys(docs, id_col, text_col)
    shown = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    cut = texts.join(repeated_bytes(texts, window), "key").mapInArrow(remove_bytes, "key long, n_removed long, n_spans long, left binary")
    cut = stored(cut.select("key", "n_removed", "n_spans", shown(F.col("left")).alias("_cut")))
    out = texts.select("key", F.octet_length("text").cast("long").alias("n_bytes"), shown(F.col("text").cast("binary")).alias("_whole")).join(cut, "key", "left")
    if ids is not None:
        out = out.join(ids, "key")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("key" if ids is None else "doc_id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("_cut", "_whole").alias("kept_sha256" if digest else "kept"),
    )
