"""Edit-aware token counts: a segment tree over a document's pre-tokens; an edit encodes again only what it touches."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a leaf when a tree is built; a leaf of over eight times as many makes the tree be built anew.
LEAF = 64

_FIELDS = ("n_chars", "n_pretokens", "n_tokens", "n_chars_after", "n_pretokens_after", "n_tokens_after", "n_reencoded")


class Counter(dict):
    """Tokens of each pre-token; emptied when it holds too many, and long ones are not kept."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 1_000_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most = regex.compile(pattern), most

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def count(self, pieces: list[str]) -> list[int]:
        return [self[p] for p in pieces]


class Tree:
    """Pre-tokens of one text, in leaves, below sums of characters, pre-tokens and tokens."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.reencoded = text, counter, 0
        pieces = counter.pattern.findall(text)
        self.build(list(map(len, pieces)), counter.count(pieces))

    def build(self, lengths: list[int], tokens: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        n = self.size
        self.sums = np.zeros((2 * n, 3), np.int64)  # children of node i are 2 i and 2 i + 1; leaves begin at n
        if lengths:
            at = np.arange(0, len(lengths), LEAF)
            leaf = self.sums[n : n + len(at)]
            leaf[:, 0], leaf[:, 2] = np.add.reduceat(lengths, at), np.add.reduceat(tokens, at)
            leaf[:, 1] = [len(x) for x, _ in self.leaves]
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    @property
    def totals(self) -> tuple[int, int, int]:
        """Characters, pre-tokens, tokens."""
        return tuple(map(int, self.sums[1]))

    def find(self, char: int) -> tuple[int, int, int]:
        """Leaf and place in it of the pre-token that holds a character, and the character it begins at."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.sums[node, 0] and self.sums[node + 1, 1]:
                before += int(self.sums[node, 0])
                node += 1
        leaf = node - self.size
        lengths = self.leaves[leaf][0]
        k = 0
        while k + 1 < len(lengths) and char >= before + lengths[k]:
            before += lengths[k]
            k += 1
        return leaf, k, before

    def edit(self, start: int, end: int, put: str) -> None:
        """Put a text in place of the characters from start to end.

        Pre-tokens are cut from left to right, and how one ends may hang on two characters beyond it: cutting starts over one
        pre-token before that of the character ahead of the edit. It stops where, past the edit, a pre-token begins that began
        there before, as from there on all goes as it did.
        """
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        text = self.text[:start] + put + self.text[end:]
        shift = len(put) - (end - start)
        leaf, k, at = self.find(max(0, start - 1))
        if k:
            k -= 1
            at -= self.leaves[leaf][0][k]
        else:
            back = leaf - 1
            while back >= 0 and not self.leaves[back][0]:
                back -= 1
            if back >= 0:
                leaf, k = back, len(self.leaves[back][0]) - 1
                at -= self.leaves[leaf][0][k]
        first, keep = leaf, k
        old, here, cut = at, at, []  # `old`: where the old pre-token (leaf, k) begins
        match = self.counter.pattern.match
        while True:
            while leaf < len(self.leaves) and k >= len(self.leaves[leaf][0]):
                leaf, k = leaf + 1, 0
            if here >= start + len(put):
                while leaf < len(self.leaves) and old + shift < here:
                    if k < len(self.leaves[leaf][0]):
                        old += self.leaves[leaf][0][k]
                        k += 1
                    else:
                        leaf, k = leaf + 1, 0
                if old + shift == here and old >= end:
                    break
            if here >= len(text):
                leaf, k = len(self.leaves), 0
                break
            piece = match(text, here).group()
            cut.append(piece)
            here += len(piece)
        while leaf < len(self.leaves) and k >= len(self.leaves[leaf][0]):
            leaf, k = leaf + 1, 0
        counts = self.counter.count(cut)
        self.reencoded += len(cut)
        self.text = text
        tail = ([], []) if leaf >= len(self.leaves) else (self.leaves[leaf][0][k:], self.leaves[leaf][1][k:])
        head = self.leaves[first]
        self.leaves[first] = (head[0][:keep] + [len(p) for p in cut] + tail[0], head[1][:keep] + counts + tail[1])
        for i in range(first + 1, min(leaf + 1, len(self.leaves))):
            self.leaves[i] = ([], [])
        if len(self.leaves[first][0]) > 8 * LEAF:
            self.build([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])
        else:
            self.renew(range(first, min(leaf + 1, len(self.leaves))))

    def renew(self, leaves: range) -> None:
        """Sums of some leaves and of all above them."""
        nodes = set()
        for i in leaves:
            self.sums[self.size + i] = sum(self.leaves[i][0]), len(self.leaves[i][0]), sum(self.leaves[i][1])
            nodes.add((self.size + i) // 2)
        while nodes and 0 not in nodes:
            for i in nodes:
                self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            nodes = {i // 2 for i in nodes}


_counters: dict[str, Counter] = {}


def counted(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text, edits): doc_id and the counts before and after the edits."""
    counter = _counters.get(ranks_path) or _counters.setdefault(ranks_path, Counter(ranks_path, pattern))
    for b in batches:
        rows = []
        for text, edits in zip(b.column(1), b.column(2), strict=True):
            tree = Tree(text.as_py() or "", counter)
            before = tree.totals
            for e in edits.as_py() or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["put"] or "")
            rows.append((*before, *tree.totals, tree.reencoded))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7))], ["doc_id", *_FIELDS])


def count_with_edits(docs: DataFrame, edits: Callable | str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, characters, pre-tokens and tokens before and after its edits, and pre-tokens encoded again.

    edits: a column (or a function of the docs that gives one) of array<struct<start, end, put>>, applied in turn to the text
    as it then is, in characters. Places beyond the text mean its end; null edits, places and texts count as none, 0 and ''.

    Nulls: a null text is empty and can be edited; a null id stays null. Repeated rows are counted each. Other columns are
    ignored. Empty table: no rows.
    """
    column = edits(docs) if callable(edits) else F.col(edits)
    kind = "array<struct<start:long,end:long,put:string>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), column.cast(kind).alias("edits"))
    return rows.mapInArrow(lambda it: counted(it, ranks_path, pattern), "doc_id long, " + ", ".join(f"{c} long" for c in _FIELDS))


def drill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Three edits of every document, fixed by its id: a replacement, an insertion and a deletion."""
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    spot = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n + 1)
    edit = lambda s, length, put: F.struct(s.alias("start"), (s + length).alias("end"), F.lit(put).alias("put"))
    return F.array(edit(spot(1), 12, "they've edited 42"), edit(spot(2), 0, "  an added line\n\n"), edit(spot(3), 30, ""))
