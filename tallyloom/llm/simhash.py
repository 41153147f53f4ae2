"""SimHash near-dedup: fingerprints of word shingles, joined with themselves by walking pairs of nodes of binary tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, drop_stored, stored
from tallyloom.llm.components import components
from tallyloom.llm.words import BLANK, LOWER, chunks

#: Fingerprints of a node at most; nodes with more are split into deeper ones before fingerprints are dealt.
NODE = 4096
#: Bits by which a node that is too large is split at a time.
STEP = 3
#: Node pairs of at most this many fingerprint pairs are leaves; node pairs walked, and fingerprint pairs compared, at a time.
LEAF, WALK, COMPARE = 64, 1 << 15, 1 << 20
#: Fingerprints that a task walks at a time, unless one unit has more (two nodes at most).
HELD = 200_000
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 14


def fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text): doc_id and fp. Bit i of fp is 1 if it is set in over half the hashes of all shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    for b in batches:
        for c in chunks(b.column(1)):
            docs = len(c.offsets) - 1
            # words in lower case, each white space run one space: a shingle is then a slice
            text = LOWER[c.data]
            solid = ~BLANK[text]
            keep = solid.copy()
            keep[1:] |= solid[:-1]
            text[~solid] = 0x20
            at = np.cumsum(keep) - 1
            flat = text[keep].tobytes()
            words = np.diff(c.words)
            runs = c.runs(width)
            short = np.flatnonzero((words > 0) & (words < width))
            first = np.concatenate([runs, c.words[:-1][short]])
            last = np.concatenate([runs + width - 1, c.words[1:][short] - 1])
            order = np.argsort(first, kind="stable")
            first, last = first[order], last[order]
            of = np.searchsorted(c.words, first, "right") - 1
            lo, hi = at[c.starts[first]], at[c.ends[last] - 1] + 1
            ones = np.zeros((docs, 64), np.int64)
            for i in range(0, len(lo), COUNTED):
                j = min(i + COUNTED, len(lo))
                h = np.fromiter((digest(flat[x:y], seed) for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist(), strict=True)), np.uint64, j - i)
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                new = np.flatnonzero(np.diff(of[i:j], prepend=-1))
                ones[of[i:j][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
            total = np.bincount(of, minlength=docs)
            fp = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, docs), pa.array(fp)], ["doc_id", "fp"])


def leads(most: int) -> list[int]:
    """Lengths of most + 1 consecutive blocks of 64 bits. Fingerprints that differ in at most `most` bits are equal in a block."""
    return [64 * (i + 1) // (most + 1) - 64 * i // (most + 1) for i in range(most + 1)]


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    """Bits `by` and following come first."""
    return (fp << np.uint64(by)) | (fp >> np.uint64(64 - by)) if by else fp


def prefix_length(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values."""
    out = np.zeros(len(x), np.int64)
    x = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1) << np.uint64(64 - s)
        out[low] += s
        x[low] <<= np.uint64(s)
    return out + (x == 0)


def split_at(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where, in sorted ranges whose codes agree before that bit, the codes with the bit set begin."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1) << (np.uint64(63) - bit.astype(np.uint64))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (codes[np.minimum(mid, len(codes) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def near_pairs(codes: np.ndarray, pairs: np.ndarray, most: int, known: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of codes that differ in at most `most` bits, by walking pairs of trie nodes.

    A node is a range of sorted distinct codes that agree in their first bits. pairs: rows of (first, end, first, end) of two
    nodes, both ends equal for a node with itself. Up to the first bit in which either node still varies, all its codes agree,
    so bits that differ there are those of any two codes; a pair with too many is left, else what varies is split at that bit.
    Nodes with themselves are walked first. known: the component of each code so far; nodes all of one component are left too.
    """
    stack = [pairs]
    while stack:
        p = stack.pop()
        if len(p) > WALK:
            stack.append(p[WALK:])
            p = p[:WALK]
        a, ae, b, be = p.T
        if known is not None:
            of = known()
            turn = np.cumsum(np.diff(of, prepend=of[0]) != 0)
            p = p[(of[a] != of[b]) | (turn[a] != turn[ae - 1]) | (turn[b] != turn[be - 1])]
            a, ae, b, be = p.T
        x, y = codes[a], codes[b]
        own = a == b
        va, vb = prefix_length(x ^ codes[ae - 1]), prefix_length(y ^ codes[be - 1])
        agree = np.minimum(va, vb)
        seen = np.where(agree > 0, (x ^ y) >> (np.uint64(64) - np.maximum(agree, 1).astype(np.uint64)), 0)
        able = (np.bitwise_count(seen) <= most) & (~own | (ae - a > 1))
        few = able & ((ae - a) * (be - b) <= LEAF)
        yield from compared(codes, p[few], most)
        go = able & ~few
        p, own, va, vb, agree = p[go], own[go], va[go], vb[go], agree[go]
        if not len(p):
            continue
        a, ae, b, be = p.T
        ma = np.where(va == agree, split_at(codes, a, ae, agree), ae)  # a side that doesn't vary there stays whole
        mb = np.where(vb == agree, split_at(codes, b, be, agree), be)
        kids = [np.stack(x, axis=1) for x in ((a, ma, b, mb), (ma, ae, mb, be), (a, ma, mb, be))] + [np.stack((ma, ae, b, mb), axis=1)[~own]]
        kids = np.concatenate(kids)
        stack.append(kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3])])


def compared(codes: np.ndarray, pairs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves: all pairs of codes of two nodes."""
    per = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    ends = np.cumsum(per)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARE, "right")))
        a, _, b, be = pairs[at:to].T
        n = per[at:to]
        row = np.repeat(np.arange(to - at), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = (be - b)[row]
        i, j = a[row] + k // wide, b[row] + k % wide
        near = (np.bitwise_count(codes[i] ^ codes[j]) <= most) & ((a != b)[row] | (i < j))
        yield i[near], j[near]
        at = to


class Forest:
    """Links among n items, kept as a tree for each component: of the pairs of a group of k, k - 1 are left."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return i, self.root[i]


def walked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches (unit, side, code, fp) in order of unit, side and unsigned code. A unit is a node with itself (side 0) or two nodes
    (0 and 1). Links a, b of fingerprints, a forest for all units that are walked at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def walk(unit: np.ndarray, side: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero((np.diff(unit, prepend=unit[0] - 1) != 0) | (np.diff(side, prepend=0) != 0)) if len(unit) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(unit))
        first = side[starts] == 0
        other = np.zeros(len(starts), bool)
        other[:-1] = ~first[1:]
        a = np.flatnonzero(first)
        b = np.where(other[a], a + 1, a)
        # equal fingerprints of several units are one item, so that each link is kept once
        names, item = np.unique(fp, return_inverse=True)
        forest = Forest(len(names))
        for i, j in near_pairs(code, np.stack([starts[a], ends[a], starts[b], ends[b]], axis=1), most, lambda: forest.root[item]):
            forest.add(item[i], item[j])
        i, j = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], ["a", "b"])

    def flush(all_: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        unit, side, code, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        cut = len(unit) if all_ else int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
        held.clear()
        if cut < len(unit):
            held.append((unit[cut:], side[cut:], code[cut:], fp[cut:]))
        if cut:
            yield walk(unit[:cut], side[:cut], code[:cut], fp[:cut])

    for b in batches:
        unit, side, code, fp = (c.to_numpy() for c in b.columns)
        held.append((unit, side, code.view(np.uint64) ^ np.uint64(1 << 63), fp))
        if sum(len(x[0]) for x in held) >= HELD:
            yield from flush(False)
    yield from flush(True)


def _codes(nodes: DataFrame, most: int) -> DataFrame:
    """trie, code, fp: each fingerprint's bits in the order of each trie. Codes have their first bit flipped, so that signed order is theirs."""
    turned, at = [], 0
    for k, n in enumerate(leads(most)):
        fp = F.col("fp")
        code = F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, 64 - at)) if at else fp
        turned.append(F.struct(F.lit(k).alias("trie"), code.bitwiseXOR(F.lit(-(2**63))).alias("code")))
        at += n
    return nodes.select("fp", F.explode(F.array(*turned)).alias("t")).select("t.trie", "t.code", "fp")


def _prefix(depth: int) -> F.Column:
    """The first bits of a code, as they are in the trie."""
    return F.shiftrightunsigned(F.col("code").bitwiseXOR(F.lit(-(2**63))), 64 - depth) if depth < 64 else F.col("code").bitwiseXOR(F.lit(-(2**63)))


def _split_nodes(spark: SparkSession, crowded: DataFrame, lead: int, most: int, node: int) -> DataFrame:
    """unit, side, code, fp of pairs of nodes that are small enough. crowded: trie, code, fp of nodes of `lead` bits that are not.

    The walk over node pairs goes on as joins: pairs with more than two nodes' worth of fingerprints give way to the pairs of
    their children, less those that differ in too many bits. Only counts of nodes take part until all pairs are small.
    """
    depth, depths, done, made = lead, [lead], [], []
    sizes = lambda d: crowded.groupBy("trie", _prefix(d).alias("p")).agg(F.count("*").alias("n"))
    now = stored(sizes(depth))
    made.append(now)
    pairs = now.select("trie", F.col("p").alias("a"), F.col("p").alias("b"))
    while True:
        side = lambda s, now=now: now.select("trie", F.col("p").alias(s), F.col("n").alias(f"n{s}"))
        met = stored(pairs.join(side("a"), ["trie", "a"]).join(side("b"), ["trie", "b"]))
        made.append(met)
        small = F.col("na") + F.col("nb") <= 2 * node
        done.append(met.where(small).select(F.lit(depth).alias("depth"), "trie", "a", "b"))
        big = met.where(~small)
        if depth == 64 or big.isEmpty():
            break
        step = min(STEP, 64 - depth)
        depth += step
        depths.append(depth)
        now = stored(sizes(depth))
        made.append(now)
        kid = lambda s, now=now, step=step: now.select("trie", F.shiftrightunsigned("p", step).alias(s), F.col("p").alias(f"{s}_"))
        below = big.select("trie", "a", "b").join(kid("a"), ["trie", "a"]).join(kid("b"), ["trie", "b"])
        below = below.where((F.col("a") != F.col("b")) | (F.col("a_") <= F.col("b_"))).where(F.bit_count(F.col("a_").bitwiseXOR(F.col("b_"))) <= most)
        pairs = below.select("trie", F.col("a_").alias("a"), F.col("b_").alias("b"))
    units = done[0]
    for d in done[1:]:
        units = units.unionByName(d)
    # units of crowded nodes are negative, those of the others are not
    units = stored(units.withColumn("unit", -1 - F.monotonically_increasing_id()))
    drop_stored(*made)
    dealt = None
    for of in depths:
        here = units.where(F.col("depth") == of)
        sides = here.select("unit", F.lit(0).alias("side"), "trie", F.col("a").alias("p")).unionByName(here.where("a != b").select("unit", F.lit(1).alias("side"), "trie", F.col("b").alias("p")))
        got = crowded.withColumn("p", _prefix(of)).join(sides, ["trie", "p"]).select("unit", "side", "code", "fp")
        dealt = got if dealt is None else dealt.unionByName(got)
    return dealt


def links_of(nodes: DataFrame, most: int, node: int = NODE) -> DataFrame:
    """nodes: fp, distinct. Links a, b that join all fingerprints of a component by links of at most `most` differing bits.

    There are most + 1 tries, each of the same bits in another order: two fingerprints that differ in few enough bits are equal in one of
    most + 1 blocks, so each trie begins with another block, and its walk begins at that depth with each node and itself.
    """
    spark = nodes.sparkSession
    turned = _codes(nodes, most)
    widths = leads(most)
    top = F.element_at(F.array(*[_prefix(w) for w in widths]), F.col("trie") + 1)
    named = turned.withColumn("unit", F.shiftleft(F.col("trie").cast("long"), 56).bitwiseOR(top))
    per = named.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1")
    # at most as many nodes as the blocks have values
    counts = stored(per)
    crowd = stored(counts.where(F.col("n") > node).select("unit"))
    wide = crowd.count()
    plain = named.join(broadcast_if_small(counts.where(F.col("n") <= node).select("unit"), counts.count()), "unit", "left_semi").select("unit", F.lit(0).alias("side"), "code", "fp")
    if wide:
        held = stored(named.join(broadcast_if_small(crowd, wide), "unit", "left_semi").select("trie", "code", "fp"))
        for k, w in enumerate(widths):
            own = held.where(F.col("trie") == k)
            if not own.isEmpty():
                plain = plain.unionByName(_split_nodes(spark, own, w, most, node))
    tasks = plain.repartition("unit").sortWithinPartitions("unit", "side", "code")
    return tasks.mapInArrow(lambda it: walked(it, most), "a long, b long").distinct()


def near_classes(docs: DataFrame, width: int = 4, most: int = 4, seed: int = 42, node: int = NODE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links, itself included).

    Shingles are `width` words in lower case (A-Z) joined by one space, repeats included; of fewer words, all of them. A bit of a
    fingerprint is 1 if set in over half of the shingles' XXH64. Rows link where fingerprints differ in at most `most` bits. Rows
    of equal fingerprints are one node from the start, so copies make no pairs. A task keeps a forest of the links that it finds.

    Nulls: a null text has no words; without words the fingerprint is zero, which links like any other. A null id never is a
    component_id unless all ids of its component are null. Repeated rows are returned each. Other columns are ignored. Empty table: no rows.
    """
    if not 0 < most < 64:
        raise ValueError("1 to 63 differing bits")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(lambda it: fingerprints(it, width, seed), "doc_id long, fp long"))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = stored(links_of(nodes.select("fp"), most, node))
    part = components(links).select(F.col("a").alias("fp"), F.col("b").alias("label"))
    labelled = nodes.join(broadcast_if_small(part, part.count()), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(labelled.join(ids, "label").select("fp", "component_id"))
    drop_stored(links)
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(broadcast_if_small(of, of.count()), "fp").select("doc_id", hex_.alias("fingerprint"), "component_id")
