"""Vectors as exact integers: cleaning, magnitudes that 64 bits can hold, and sums gathered from tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column that hold neither nulls nor non-finite values, and offsets and values (float64) of all rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(good), offsets, values


def largest(width: int) -> int:
    """Components up to this in absolute value keep squared distances of so many components within a long."""
    return int((2**62 // max(1, width)) ** 0.5) // 2


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, others: dict[str, str], length: int | None = None) -> DataFrame:
    """id (long), x (array of long, floor(scale * component)) and `others` (new name: column) of the rows whose vector is fit.

    Rows are left out where the vector is null, holds null or non-finite components, or has another length than `length`.
    A component so large that a squared distance would not fit a long is refused, as no result could hold it.
    """
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), *(F.col(c).alias(n) for n, c in others.items()))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offsets, values = finite_rows(b.column(1))
            if length is not None:
                rows = rows[offsets[rows + 1] - offsets[rows] == length]
            counts = offsets[rows + 1] - offsets[rows]
            ends = np.cumsum(counts)
            at = np.repeat(offsets[rows] - (ends - counts), counts) + np.arange(int(counts.sum()))
            x = np.floor(values[at] * scale)
            if len(x) and np.abs(x).max() > largest(int(counts.max())):
                raise ValueError(f"components beyond {largest(int(counts.max()))} / {scale}: squared distances would not fit 64 bits")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x.astype(np.int64)))
            took = [b.column(k).take(pa.array(rows)) for k in range(b.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([took[0], lists, *took[1:]], ["id", "x", *others])

    return picked.mapInArrow(run, ", ".join([f"id {kinds['id']}", "x array<long>", *(f"`{n}` {kinds[n]}" for n in others)]))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of `width` integers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def sums_by(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups that occur, rows of each, and exact sums of their rows of x."""
    order = np.argsort(group, kind="stable")
    found, first = np.unique(group[order], return_index=True)
    counts = np.diff(np.append(first, len(group)))
    return found, counts, np.add.reduceat(x[order], first, axis=0) if len(group) else x[:0]


def gathered(partials: DataFrame, keys: list[str]) -> dict[tuple, tuple[int, list[int]]]:
    """Rows and exact component sums by key. partials: keys, n, sums (array of long), some rows for each task.

    As many rows as keys times components reach the driver; both are parameters of a method, not of the data.
    """
    flat = partials.select(*keys, "n", F.posexplode("sums").alias("_pos", "_s"))
    total = flat.groupBy(*keys, "_pos").agg(F.sum("n").alias("n"), F.sum(F.col("_s").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple, tuple[int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: r["_pos"]):
        out.setdefault(tuple(r[k] for k in keys), (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def first_rows(rows: DataFrame, order: list[Column], n: int) -> np.ndarray:
    """x of the first n rows (n is a parameter of a method)."""
    return np.array([r["x"] for r in rows.orderBy(*order).limit(n).select("x").collect()], np.int64)
