"""Regions of texts that may repeat: content-defined anchors find them without moving or comparing whole texts.

A text is a sequence of units (words or bytes). Each window of n units names one of its grams, the one of least hash, so equal
windows name equal grams. A window is a candidate if the gram it names is named at two places or more. A region is a run of
candidate windows of one text that name the same gram at the same place; equal windows lie in regions of the same gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BASE, bucketed, drop_stored, mixed, rolling, stored
from tallyloom.llm.words import BYTES, Chunk, buffers, pieces, ragged, split

#: Places that name a gram beyond which its windows are dealt one by one, by a hash of their whole content; of words and bytes.
HOT = {False: 20_000, True: 100_000}

#: Bytes of text that are worked on at a time, unless one document is longer: arrays of several values a byte stay in a core's cache.
PART = 1 << 17


@dataclass(frozen=True)
class Scheme:
    """Units of texts, the length of a window and of a gram in units."""

    bytes: bool
    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """key and text of each row, and a table of key and doc_id where the ids themselves won't do.

    Keys rise with ids. Where ids are null or repeat, rows are sorted by id (nulls last) and text, and numbered. Texts are dealt
    by key once, so that the joins that follow move lists of places to them, and no text again.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    good = base.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if (good["n"] or 1) == 1 and not good["none"]:
        return bucketed(base.withColumnRenamed("doc_id", "key"), "key"), None
    rows = stored(base.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("key", F.monotonically_increasing_id()))
    return bucketed(rows.select("key", "text"), "key"), rows.select("key", "doc_id")


def sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each run of w values."""
    width = 1
    out = x
    while 2 * width <= w:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(x) - w + 1], out[w - width : len(x) - width + 1]) if width < w else out


def gram_values(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash, not 0, of each run of n units. Unlike grams with equal values only meet in one group; with fewer bits, they would in a large corpus."""
    x = rolling(h, n)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.maximum(x ^ (x >> np.uint64(32)), np.uint64(1))


@dataclass
class Windows:
    """The windows of a chunk of texts."""

    chunk: Chunk
    edges: np.ndarray  # units before each text
    hashes: np.ndarray  # of units
    grams: np.ndarray
    at: np.ndarray  # units at which a window begins
    least: np.ndarray  # gram that each of them names
    span: int  # grams in a window
    covered: np.ndarray  # grams that lie in some window

    def named(self) -> np.ndarray:
        """Places of the grams that are named."""
        if not len(self.at):
            return self.at
        per = np.zeros(len(self.grams) + self.span - 1, np.uint64)
        per[self.at + self.span - 1] = self.least
        return np.flatnonzero((sliding(per, self.span, np.maximum) == self.grams) & self.covered)


def windows(column: pa.Array, scheme: Scheme) -> Iterator[Windows]:
    offsets, data = buffers(column)
    for i, j in pieces(offsets, PART):
        bytes_, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if scheme.bytes:
            c, h, edges = Chunk(i, bytes_, off, off, off, off), BYTES[bytes_], off
        else:
            c = split(bytes_, off, i)
            h, edges = c.hashes(), c.words
        counts = np.diff(edges)
        long = counts >= scheme.window
        at = ragged(edges[:-1][long], counts[long] - scheme.window + 1)
        if not len(at):
            none = np.empty(0, np.uint64)
            yield Windows(c, edges, h, none, at, none, scheme.grams, np.empty(0, bool))
            continue
        grams = gram_values(h, scheme.gram)
        covered = np.zeros(len(grams), bool)
        covered[ragged(edges[:-1][long], counts[long] - scheme.gram + 1)] = True
        yield Windows(c, edges, h, grams, at, sliding(grams, scheme.grams, np.minimum)[at], scheme.grams, covered)


def regions(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """docs: key, text. One row per region: m (its gram, or another hash of its one window where the gram is hot), tid (64-bit hash of
    its content; with m it names the content), key, start, length and anchor (units; anchor: from start to the gram)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for w in windows(b.column(1), scheme):
                p = w.named()
                k = keys[w.chunk.first + np.searchsorted(w.edges, p, "right") - 1]
                order = np.lexsort((k, w.grams[p]))
                h, k = w.grams[p][order], k[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(k[first], pa.int64()), pa.array(n, pa.int32())], ["h", "key", "n"])

    posted = stored(docs.mapInArrow(anchors, "h long, key long, n int"))
    repeated = posted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > HOT[scheme.bytes]).alias("hot"))
    by_text = posted.join(repeated, "h").groupBy("key").agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("cool"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            cool, hot = b.column(2), b.column(3)
            for w in windows(b.column(1), scheme):
                yield from cut(w, keys, cool, hot, scheme)

    joined = docs.join(by_text, "key").select("key", "text", "cool", "hot")
    out = stored(joined.mapInArrow(found, "m long, tid long, key long, start long, length int, anchor int"))
    drop_stored(posted)
    return out


def contents(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """docs: key, text; wanted: m, tid, key, start, length, anchor. Those columns and content (bytes; words joined by one space)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("m", "tid", "start", "length", "anchor")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column(1))
            keys, lists_ = b.column(0).to_numpy(), b.column(2)
            for i, j in pieces(offsets):
                c = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i) if not scheme.bytes else None
                text = data[offsets[i] : offsets[j]].tobytes()
                edges = offsets[i : j + 1] - offsets[i] if scheme.bytes else c.words
                flat = lists_.slice(i, j - i).flatten()
                m, tid, start, length, anchor = (flat.field(k) for k in range(5))
                per = np.diff(lists_.offsets.to_numpy()[i : j + 1])
                begin = start.to_numpy() + np.repeat(edges[:-1], per)
                yield pa.RecordBatch.from_arrays(
                    [m, tid, pa.array(np.repeat(keys[i:j], per)), start, length, anchor, pa.array(slices(c, text, begin, begin + length.to_numpy(), scheme), pa.binary())],
                    ["m", "tid", "key", "start", "length", "anchor", "content"],
                )

    kind = "m long, tid long, key long, start long, length int, anchor int, content binary"
    return docs.join(lists, "key").select("key", "text", "r").mapInArrow(run, kind)


def slices(c: Chunk | None, text: bytes, begin: np.ndarray, end: np.ndarray, scheme: Scheme) -> list[bytes]:
    """Units from begin to end: bytes, or words joined by one space."""
    if scheme.bytes:
        return [text[i:j] for i, j in zip(begin, end, strict=True)]
    lo, hi = c.starts[begin], c.ends[end - 1]
    # words one byte apart and by a space need no joining
    tidy = np.concatenate([[0], np.cumsum((c.starts[1:] - c.ends[:-1] != 1) | (c.data[c.ends[:-1]] != 0x20))])
    clean = tidy[end - 1] == tidy[begin]
    return [text[i:j] if ok else b" ".join(text[i:j].split()) for i, j, ok in zip(lo, hi, clean, strict=True)]


def cut(w: Windows, keys: np.ndarray, cool: pa.Array, hot: pa.Array, scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """The regions of a chunk, given the repeated grams of each of its texts."""
    if not len(w.at):
        return
    # runs of windows that name one gram; a run is looked up, not each window
    new = np.ones(len(w.at), bool)
    new[1:] = (w.least[1:] != w.least[:-1]) | (w.at[1:] != w.at[:-1] + 1)
    runs = np.flatnonzero(new)
    of = np.searchsorted(w.edges, w.at[runs], "right") - 1
    texts = len(w.edges) - 1

    def named(texts_: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """A value for a gram of a text. Should two of them meet in one value, windows are looked at in vain, and none is lost."""
        return mixed(grams + texts_.astype(np.uint64) * np.uint64(BASE))

    wanted = named(of, w.least[runs])

    def among(lists: pa.Array) -> np.ndarray:
        own = lists.slice(w.chunk.first, texts)
        per = np.diff(own.offsets.to_numpy())
        held = np.sort(named(np.repeat(np.arange(texts), per), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        return held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted if len(held) else np.zeros(len(wanted), bool)

    single = among(hot)
    candidate = among(cool) | single
    lengths = np.diff(np.append(runs, len(w.at)))
    pick = ragged(runs[candidate], lengths[candidate])
    if not len(pick):
        return
    at, least, one, of = w.at[pick], w.least[pick], np.repeat(single[candidate], lengths[candidate]), np.repeat(of[candidate], lengths[candidate])
    named = w.named()
    # the first place of the gram in each window
    j = np.searchsorted(named, at)
    left = np.flatnonzero(w.grams[named[j]] != least)
    while len(left):
        j[left] += 1
        left = left[w.grams[named[j[left]]] != least[left]]
    place = named[j]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | one[1:] | one[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin, end = at[first], at[last] + scheme.window
    c = w.chunk
    texts_of = slices(c, c.data.tobytes(), begin, end, scheme)
    tid = np.array([xxhash.xxh3_64_intdigest(x) for x in texts_of], np.uint64).view(np.int64)
    m = least[first].view(np.int64).copy()
    alone = np.flatnonzero(one[first])  # with tid, 128 bits name the window
    m[alone] = np.array([xxhash.xxh3_64_intdigest(texts_of[k], 1) for k in alone], np.uint64).view(np.int64)
    columns = [m, tid, keys[c.first + of[first]], begin - w.edges[of[first]], (end - begin).astype(np.int32), (place[first] - begin).astype(np.int32)]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["m", "tid", "key", "start", "length", "anchor"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]
