"""Vector code compression: product codes learnt in integers, screened by float32 matrix products with rigorous error intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, drop_stored, stored
from tallyloom.llm.vectors import first_rows, gathered, integer_vectors, matrix, sums_by

#: Vectors that are screened at a time.
BLOCK = 4096
#: Unit roundoff of float32.
UNIT = 2.0**-24


class Screen:
    """Entries of a codebook, ready to be screened against vectors.

    Of a vector x, entries c are ordered by |c|^2 / 2 - x . c. In float32, with n components, rounding of both factors, the sum
    in any order, |c|^2 / 2 and the difference move that value by at most

        r = g * (|x| * |c| + |c|^2 / 2),    g = (n + 4) * u / (1 - (n + 4) * u),    u = 2^-24,

    where |x . c| and the sum of its absolute terms are at most |x| * |c|. g is raised by a millionth, far above what float64
    loses in r itself. An entry whose interval (value - r to value + r) begins above the least end of all can't be nearest.
    """

    def __init__(self, book: np.ndarray):
        self.book, n = book, book.shape[1]
        squares = (book.astype(np.float64) ** 2).sum(axis=1)
        self.columns = np.ascontiguousarray(book.T.astype(np.float32))
        self.half, self.norm = squares / 2, np.sqrt(squares)
        self.half32 = self.half.astype(np.float32)
        self.g = (n + 4) * UNIT / (1 - (n + 4) * UNIT) * (1 + 1e-6)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and entries whose intervals overlap the best, by row and then entry."""
        value = (self.half32 - x.astype(np.float32) @ self.columns).astype(np.float64)
        radius = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.norm
        radius += self.half
        radius *= self.g
        best = (value + radius).min(axis=1)
        value -= radius
        return np.nonzero(value <= best[:, None])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the lower index) and squared distance of each row, exact in int64."""
        index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            row, entry = self.candidates(part)
            d = ((part[row] - self.book[entry]) ** 2).sum(axis=1)
            order = np.lexsort((entry, d, row))
            first = order[np.searchsorted(row, np.arange(len(part)))]  # each row has a candidate, and rows stay in place
            index[at : at + BLOCK], distance[at : at + BLOCK] = entry[first], d[first]
        return index, distance


def _sums(batches: Iterator[pa.RecordBatch], screens: list[Screen], width: int) -> Iterator[pa.RecordBatch]:
    """Rows and sums of the parts nearest to each entry, once for each task."""
    k = len(screens[0].book)
    n, s = np.zeros((len(screens), k), np.int64), np.zeros((len(screens), k, width), np.int64)
    for b in batches:
        x = matrix(b.column(0), width * len(screens))
        for p, screen in enumerate(screens):
            own = x[:, p * width : (p + 1) * width]
            entry, counts, sums = sums_by(screen.nearest(own)[0], own)
            n[p, entry] += counts
            s[p, entry] += sums
    part, entry = np.nonzero(n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(s[part, entry].reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], ["part", "entry", "n", "sums"])


def learnt(rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after so many rounds over rows (id, x)."""
    width = length // parts
    first = first_rows(rows, [F.col("id").asc_nulls_last(), F.col("x").asc()], entries)
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not width:
        return books
    for _ in range(rounds):
        screens = [Screen(b) for b in books]
        partials = rows.select("x").mapInArrow(lambda it, screens=screens: _sums(it, screens, width), "part int, entry int, n long, sums array<long>")
        for (part, entry), (n, sums) in gathered(partials, ["part", "entry"]).items():
            books[part, entry] = [s // n for s in sums]
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the codebooks they refer to.

    The table has vec_id, code (two hex digits a part), error (squared distances summed over parts) and label_error (error
    summed over equal labels, nulls together). Components count as floor(scale * x). Codebooks (at most 256 entries, so their
    size does not grow with the data) start as the parts of the smallest ids; each round assigns all vectors to nearest entries
    and replaces entries by floored means. A task sends one row of sums for each entry, whatever its vectors.

    Nulls: vectors that are null or hold null or non-finite components are left out; null ids come last and ids that repeat are
    ordered by vector. Only vectors of the commonest length take part (of lengths equally common, the shorter); it must be a multiple of
    `parts`. Fewer vectors than entries: as many entries. Components too large for 64-bit distances are refused. Other
    columns are ignored. Empty table: no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark, kind = vectors.sparkSession, vectors.schema[label_col].dataType.simpleString()
    kept = stored(integer_vectors(vectors, scale, id_col, vector_col, {"label": label_col}))
    common = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long"), np.empty((parts, 0, 0), np.int64)
    length = common["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows, width = kept.where(F.size("x") == length), length // parts
    books = learnt(rows, length, parts, entries, rounds)
    screens = [Screen(b) for b in books] if width else []

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = np.zeros((len(b), parts), np.uint8), np.zeros(len(b), np.int64)
            x = matrix(b.column(1), length) if width else None
            for p, screen in enumerate(screens):
                index, distance = screen.nearest(x[:, p * width : (p + 1) * width])
                codes[:, p] = index
                error += distance
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(b), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), raw, pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = stored(rows.select("id", "x", "label").mapInArrow(assign, f"vec_id long, label {kind}, code binary, error long"))
    drop_stored(kept)
    # labels are summed before they meet their rows; a label of many rows is never one task's
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    met = coded.join(broadcast_if_small(totals, totals.count()), F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error"), books
