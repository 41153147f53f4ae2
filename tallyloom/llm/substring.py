"""Substring dedup: suffix automata of reference shards, streamed against for matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, drop_stored, stored
from tallyloom.llm.regions import Scheme, contents, regions, with_keys
from tallyloom.llm.words import chunks

#: Words of a gram that names windows.
GRAM = 6


class SuffixAutomaton:
    """Of several sequences of integers; each state keeps the least place at which its strings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [(1 << 63, 0)]

    def add(self, sequence: list[int], key: int, start: int) -> None:
        """Extend by a sequence that begins at unit `start` of text `key`."""
        nxt, link, length, place = self.next, self.link, self.length, self.place
        last = 0
        for at, c in enumerate(sequence, start):
            here = (key, at)
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if here < place[q]:
                    place[q] = here
                continue
            cur = len(nxt)
            if q is None:
                nxt.append({})
                length.append(length[last] + 1)
                place.append(here)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                p, cur = last, -1
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            place.append(place[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur >= 0:
                link[cur] = clone
                last = cur
            else:
                last = clone
                if here < place[clone]:
                    place[clone] = here

    def finish(self) -> None:
        """A state's strings also end wherever those of the states that link to it end."""
        link, place = self.link, self.place
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if place[s] < place[link[s]]:
                place[link[s]] = place[s]

    def matches(self, sequence: list[int], n: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Matching statistics: each place at which a match of n units ends, and the least place at which it ends in a reference."""
        nxt, link, length = self.next, self.link, self.length
        s = held = 0
        for at, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                held = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                held += 1
            while length[link[s]] >= n if s else False:  # the state whose strings include the last n units
                s = link[s]
                held = length[s]
            if held >= n:
                yield at, self.place[s]


def first_places(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches (m, tid, content, key, start) sorted by m, one row per distinct region with its first place. For runs of its
    windows, the first place of the like: m, tid, i (first window of the run), length, key, start."""
    out: list[tuple] = []

    def shard(m: int, held: list[tuple]) -> None:
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in content.split()] for _, content, _, _ in held]
        automaton = SuffixAutomaton()
        for seq, (_, _, key, start) in zip(sequences, held, strict=True):
            automaton.add(seq, key, start)
        automaton.finish()
        for seq, (tid, _, _, _) in zip(sequences, held, strict=True):
            run = None
            for at, (key, end) in automaton.matches(seq, n):
                i, first = at - n + 1, end - n + 1
                if run and run[2] + run[3] == i and run[4] == key and run[5] + run[3] == first:
                    run[3] += 1
                else:
                    if run:
                        out.append(tuple(run))
                    run = [m, tid, i, 1, key, first]
            if run:
                out.append(tuple(run))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["m", "tid", "i", "length", "key", "start"])

    now, held = None, []
    for b in batches:
        for m, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if m != now and held:
                shard(now, held)
                held = []
            now = m
            held.append(row)
        if len(out) > 20_000:
            yield batch()
    if held:
        shard(now, held)
    yield batch()


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """docs: key, text. key and spans (arrays of start and end word) covered by windows that also start earlier."""
    scheme = Scheme(False, window, min(GRAM, window))
    found = regions(docs, scheme)
    firsts = found.groupBy("m", "tid").agg(F.min(F.struct("key", "start")).alias("f"), F.first("length").alias("length"), F.first("anchor").alias("anchor"))
    distinct = contents(docs, firsts.select("m", "tid", "f.key", "f.start", "length", "anchor"), scheme)
    ranked = distinct.select("m", "tid", "content", "key", "start").repartition("m").sortWithinPartitions("m", "key", "start")
    places = stored(ranked.mapInArrow(lambda it: first_places(it, window), "m long, tid long, i int, length int, key long, start long"))
    members = found.select("m", "tid", F.col("key").alias("own"), F.col("start").alias("at"))
    later = members.join(places, ["m", "tid"]).where((F.col("key") < F.col("own")) | ((F.col("key") == F.col("own")) & (F.col("start") < F.col("at") + F.col("i"))))
    span = F.struct((F.col("at") + F.col("i")).alias("s"), (F.col("at") + F.col("i") + F.col("length") - 1 + window).alias("e"))
    out = stored(later.groupBy(F.col("own").alias("key")).agg(F.collect_set(span).alias("spans")))
    drop_stored(found, places)
    return out


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text, spans): key, words removed, and the text that is left, words joined by one space."""
    for b in batches:
        spans = b.column(2)
        removed, left = [], []
        for c in chunks(b.column(1)):
            text = c.data.tobytes()
            for k in range(len(c.offsets) - 1):
                words = text[c.offsets[k] : c.offsets[k + 1]].split()
                gone = np.zeros(len(words), bool)
                for x in spans[c.first + k].as_py():
                    gone[x["s"] : x["e"]] = True
                removed.append(int(gone.sum()))
                left.append(b" ".join(words[i] for i in np.flatnonzero(~gone)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(left, pa.binary())], ["key", "n_removed", "left"])


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and kept (the words left, joined by one space) or, with digest, kept_sha256 of it.

    A word goes if a window of `window` words covers it whose words also start earlier: in a row of smaller id, or earlier in
    the same row. Windows are judged on the input. Regions of windows whose gram repeats (see regions.py) are brought
    together by gram, so each shard holds all the like of its windows; a shard's automaton is built from its distinct
    regions, each with its first place, and they are streamed against it. Shards are dealt by key, not broadcast, as what
    repeats in a corpus has no size bound.

    Nulls: a null text has no words; null ids come last. Rows that repeat an id are ordered by a hash of their text. Other
    columns are ignored. Empty table: no rows.
    """
    texts, ids = with_keys(docs, id_col, text_col)
    shown = (lambda c: F.sha2(c.cast("binary"), 256)) if digest else (lambda c: c.cast("string"))
    cut = texts.join(repeated_spans(texts, window), "key").mapInArrow(remove_spans, "key long, n_removed long, left binary")
    cut = stored(cut.select("key", "n_removed", shown(F.col("left")).alias("_cut")))
    whole = shown(F.trim(F.regexp_replace("text", SPACE, " ")))
    n = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")
    out = texts.select("key", n.alias("n_words"), whole.alias("_whole")).join(cut, "key", "left")
    if ids is not None:
        out = out.join(ids, "key")
    return out.select(
        F.col("key" if ids is None else "doc_id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("_cut", "_whole").alias("kept_sha256" if digest else "kept"),
    )
