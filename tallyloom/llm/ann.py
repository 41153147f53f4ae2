"""Approximate nearest neighbours by an inverted multi-index: two halves of a vector are quantised apart."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

#: Centroids of each half, and vectors that they are fitted on at most: those of least hash.
CENTROIDS, FIT_ROWS, FIT_STEPS = 32, 10_000, 12
#: A query's cells are taken in order of summed distance until they hold this share of all vectors, or this many.
SHARE, LEAST = 0.6, 2000
#: Vectors of a block of cells.
BLOCK = 20_000


def fit_half(x: np.ndarray, k: int, steps: int = FIT_STEPS) -> np.ndarray:
    """k-means of the rows of x, begun at spread-out rows."""
    k = min(k, len(x))
    r = np.random.Generator(np.random.PCG64(3))
    at = x[r.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = np.argmin((at**2).sum(axis=1) - 2 * (x @ at.T), axis=1)
        for j in range(k):
            own = x[near == j]
            at[j] = own.mean(axis=0) if len(own) else x[r.integers(len(x))]
    return at


class Codebooks:
    """Centroids of both halves of unit vectors."""

    def __init__(self, x: np.ndarray, k: int = CENTROIDS):
        self.half = x.shape[1] // 2
        self.books = [fit_half(x[:, : self.half], k), fit_half(x[:, self.half :], k)]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centroids."""
        return [np.maximum(0, (p**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (p @ b.T)) for p, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def traverse(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, most: int) -> list[int]:
        """Cells of a query in order of summed distance, by a heap over the sorted halves, until they hold `most` vectors."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, wide = a[i].tolist(), b[j].tolist(), len(b)
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        done = [-1] * (len(a) + 1)  # columns taken of each row
        while heap and held < most:
            _, x, y = heapq.heappop(heap)
            done[x] = y
            cell = int(i[x]) * wide + int(j[y])
            if sizes[cell]:
                out.append(cell)
                held += int(sizes[cell])
            if y + 1 < wide and (x == 0 or done[x - 1] >= y + 1):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if x + 1 < len(a) and done[x + 1] == y - 1:
                heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each row whose id is divisible by `every`.

    Equal vectors are one entry that keeps the k + 1 smallest ids, which is all that a query can need of it. Codebooks are
    fitted on a bounded sample; every entry is indexed. A query's cells come from the multi-index traversal; cells are cut into
    blocks of bounded size, each held against its queries by blocks, and the scores of the best are made again from the
    original vectors, term by term. Ties go to the smaller id.

    Nulls: vectors that are null, of other than the commonest length, zero, or hold null or non-finite components take no
    part, nor do null ids. Rows that repeat id and vector count once; an id with several vectors is several entries, and never its own
    neighbour. Other columns are ignored. Empty table: no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where((norm > 0) & (norm < float("inf")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = stored(rows.where(F.size("v") == length["n"]))
    small = Window.partitionBy("v").orderBy("id")
    firsts = rows.withColumn("_r", F.dense_rank().over(small)).where(F.col("_r") <= k + 1)
    entries = stored(firsts.groupBy("v").agg(F.min("id").alias("entry"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()))
    fit = entries.orderBy(F.xxhash64("v"), "entry").limit(FIT_ROWS).select("v").toArrow()
    books = Codebooks(units(matrix(fit.column("v").combine_chunks())))
    cells = len(books.books[0]) * len(books.books[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(books.cells(units(matrix(b.column(1)))) if len(b) else [], pa.int32())], ["entry", "v", "least", "cell"])

    index = stored(entries.select("entry", "v", F.element_at("ids", 1).alias("least")).mapInArrow(encode, "entry long, v array<double>, least long, cell int"))
    sizes = np.zeros(cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # as many rows as cells
        sizes[r["cell"]] = r["count"]
    total = int(sizes.sum())
    most = max(least, math.ceil(share * total))
    # cells in blocks of about BLOCK entries; a larger cell in several
    cuts = np.maximum(1, -(-sizes // BLOCK))
    first = np.zeros(cells, np.int64)
    block = held = 0
    for c in range(cells):
        if held and (held + sizes[c] > BLOCK):
            block, held = block + 1, 0
        first[c] = block
        held += sizes[c]
        if cuts[c] > 1:
            block, held = block + int(cuts[c]), 0
    asked = rows.where(F.col("id") % every == 0).select("id", "v").join(entries.select(F.col("v"), "entry"), "v")
    queries = stored(asked.groupBy("entry").agg(F.first("v").alias("v")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = books.distances(units(matrix(b.column(1)))) if len(b) else ([], [])
            q, blocks, lists = [], [], []
            for row in range(len(b)):
                by: dict[int, list[int]] = {}
                for cell in books.traverse(a[row], c[row], sizes, most):
                    for part in range(int(cuts[cell])):
                        by.setdefault(int(first[cell]) + part, []).append(cell)
                q += [row] * len(by)
                blocks += by.keys()
                lists += by.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q, pa.int64())), b.column(1).take(pa.array(q, pa.int64())), pa.array(blocks, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["entry", "v", "block", "cells"])

    cut_of = F.create_map(*[x for c in np.flatnonzero(cuts > 1) for x in (F.lit(int(c)), F.lit(int(cuts[c])))]) if (cuts > 1).any() else None
    start = F.element_at(F.array(*map(F.lit, first.tolist())), F.col("cell") + 1)
    part = F.pmod(F.xxhash64("entry"), F.coalesce(cut_of[F.col("cell")], F.lit(1)).cast("long")).cast("int") if cut_of is not None else F.lit(0)
    dealt = index.select("entry", "v", "least", "cell", (start + part).cast("int").alias("block"))
    probes = queries.mapInArrow(probe, "entry long, v array<double>, block int, cells array<int>")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches (block, asks, entry, v, least, cell, cells) in order of block, its entries before its queries, which are streamed
        against them. The best k + 1 entries of each query, by exact scores and then the smallest id.

        Exact scores are made for all entries that rounding of the product may have put below the best k + 1.
        """
        now, parts, held = None, [], None
        for b in batches:
            block, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, len(block)], strict=True):
                if i == j:
                    continue
                if block[i] != now:
                    now, parts, held = block[i], [], None
                part = b.slice(i, j - i)
                if not asks[i]:
                    parts.append((matrix(part.column(3)), *(part.column(c).to_numpy() for c in (2, 4, 5))))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    held.append(units(held[0]))
                x, ids, least_id, cell, ux = held
                bound = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps
                q, found = matrix(part.column(3)), []
                uq = units(q)
                for r, cells_ in enumerate(part.column(6).to_pylist()):
                    rows_ = np.flatnonzero(np.isin(cell, cells_))
                    s = ux[rows_] @ uq[r]
                    if len(rows_) > k + 1:
                        rows_ = rows_[s >= np.partition(s, -(k + 1))[-(k + 1)] - bound]
                    score = np.array([math.fsum(q[r] * x[t]) / (math.sqrt(math.fsum(q[r] ** 2)) * math.sqrt(math.fsum(x[t] ** 2))) for t in rows_], np.float64)
                    top = np.lexsort((least_id[rows_], -score))[: k + 1]
                    found.append((np.full(len(top), part.column(2)[r].as_py()), ids[rows_[top]], score[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "entry", "score"])

    none = F.lit(None)
    both = dealt.select("block", F.lit(0).alias("asks"), "entry", "v", "least", "cell", none.cast("array<int>").alias("cells"))
    both = both.unionByName(probes.select("block", F.lit(1).alias("asks"), "entry", "v", none.cast("long").alias("least"), none.cast("int").alias("cell"), "cells"))
    scores = both.repartition(block + 1, "block").sortWithinPartitions("block", "asks").mapInArrow(rerank, "query long, entry long, score double")
    ids = entries.select("entry", "ids")
    found = scores.join(ids, "entry").select("query", "score", "ids", F.element_at("ids", 1).alias("least"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("query", "score", "ids")
    own = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query")).distinct()
    pairs = own.join(found, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
