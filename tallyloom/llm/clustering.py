"""Centroid clustering with Drake's adaptive bounds: distances are computed only where stored bounds can't certify the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_stored, stored
from tallyloom.llm.vectors import first_rows, gathered, integer_vectors, matrix, sums_by

#: Relative margin of a bound, above all that a few float64 operations lose.
MARGIN = 2.0**-48

_STATE = "id long, x array<long>, near array<int>, upper double, lower array<double>, rest double, cluster int, n long, sums array<long>, used int, scanned long"


def above(x: np.ndarray) -> np.ndarray:
    """At least the real value that x was rounded from."""
    return x + np.abs(x) * MARGIN


def below(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * MARGIN


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c.

    Where all terms and sums are integers below 2^53, float64 products are exact in any order; else each difference is squared in int64.
    """
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - own) ** 2).sum(axis=1) for own in c], axis=1)


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and c, one by one."""
    return ((x - c) ** 2).sum(axis=1)


@dataclass
class Bounds:
    """Of each vector: its centroid and the next ones (near), an upper bound for its own, lower bounds for the next, and one for all the rest."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    used: int = 0  # tracked centroids that were looked at, at most
    scanned: int = 0  # distances computed

    @classmethod
    def scan(cls, x: np.ndarray, centroids: np.ndarray, most: int) -> Bounds:
        """From the distances to all centroids; of equal ones, the smaller number is nearer."""
        d = squared(x, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        none = np.full(len(x), np.inf)
        rest = below(far[:, most + 1]) if far.shape[1] > most + 1 else none
        return cls(order[:, : most + 1].astype(np.int32), above(far[:, 0]) if len(centroids) else none, below(far[:, 1 : most + 1]), rest, 0, d.size)

    def narrowed(self, most: int) -> Bounds:
        """With at most so many tracked centroids: the others join the rest."""
        if self.lower.shape[1] > most:
            self.rest = np.minimum(self.rest, self.lower[:, most:].min(axis=1))
            self.near, self.lower = self.near[:, : most + 1], self.lower[:, :most]
        return self

    def moved(self, drift: np.ndarray) -> Bounds:
        """After centroids have moved by at most `drift`."""
        self.upper = above(self.upper + drift[self.near[:, 0]])
        self.lower = below(self.lower - drift[self.near[:, 1:]])
        self.rest = below(self.rest - drift.max(initial=0))
        return self

    def settle(self, x: np.ndarray, centroids: np.ndarray) -> None:
        """Nearest centroids anew: first the own distance, then tracked centroids in doubt, and all of them where the rest is in doubt."""
        floor = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        at = np.flatnonzero(self.upper >= floor)
        own = paired(x[at], centroids[self.near[at, 0]])
        self.scanned += len(at)
        self.upper[at] = above(np.sqrt(own.astype(np.float64)))
        still = self.upper[at] >= floor[at]
        at, own = at[still], own[still]
        if not len(at):
            return
        row, j = np.nonzero(self.lower[at] <= self.upper[at, None])
        if len(row):
            d = paired(x[at[row]], centroids[self.near[at[row], j + 1]])
            self.scanned += len(row)
            self.used = max(self.used, int(j.max()) + 1)
            self.lower[at[row], j] = below(np.sqrt(d.astype(np.float64)))
            # the best of each vector's tracked centroids in doubt, against its own
            order = np.lexsort((self.near[at[row], j + 1], d, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            r, k = row[first], j[first]
            old, new = self.near[at[r], 0].copy(), self.near[at[r], k + 1].copy()
            better = (d[first] < own[r]) | ((d[first] == own[r]) & (new < old))
            r, k, old, new, d = r[better], k[better], old[better], new[better], d[first][better]
            self.near[at[r], 0], self.near[at[r], k + 1] = new, old
            self.lower[at[r], k] = below(np.sqrt(own[r].astype(np.float64)))
            self.upper[at[r]] = above(np.sqrt(d.astype(np.float64)))
            by = np.argsort(self.lower[at], axis=1, kind="stable")  # nearest first, so that a narrower list keeps the best
            self.lower[at] = np.take_along_axis(self.lower[at], by, axis=1)
            self.near[at, 1:] = np.take_along_axis(self.near[at, 1:], by, axis=1)
        at = at[self.upper[at] >= self.rest[at]]
        if len(at):
            new = Bounds.scan(x[at], centroids, self.lower.shape[1])
            self.near[at], self.upper[at], self.lower[at], self.rest[at] = new.near, new.upper, new.lower, new.rest
            self.scanned += new.scanned
            self.used = self.lower.shape[1]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), kind))


def _settled(b: pa.RecordBatch, x: np.ndarray, centroids: np.ndarray, drift: np.ndarray | None, most: int) -> Bounds:
    """The bounds of a batch (id, x, near, upper, lower, rest) after settling; without drift, from a first scan."""
    if drift is None or not len(b):
        return Bounds.scan(x, centroids, most)
    near = matrix(b.column(2), len(b.column(2).values) // len(b)).astype(np.int32)
    tracked = near.shape[1] - 1
    lower = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(b), tracked).copy()
    out = Bounds(near, b.column(3).to_numpy().copy(), lower, b.column(5).to_numpy().copy()).narrowed(most).moved(drift)
    out.settle(x, centroids)
    return out


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    """A task's vectors with their bounds, and behind them one row for each cluster that they fall in: how many, and their sum."""
    k, width = centroids.shape
    n, s, used, scanned = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0, 0
    names = [c.split()[0] for c in _STATE.split(", ")]
    empty = lambda m, kind: pa.nulls(m, kind)
    for b in batches:
        x = matrix(b.column(1), width)
        state = _settled(b, x, centroids, drift, most)
        used, scanned = max(used, state.used), scanned + state.scanned
        cluster, counts, sums = sums_by(state.near[:, 0], x)
        n[cluster] += counts
        s[cluster] += sums
        m = len(b)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), _lists(state.near, pa.int32()), pa.array(state.upper), _lists(state.lower, pa.float64()), pa.array(state.rest),
             empty(m, pa.int32()), empty(m, pa.int64()), empty(m, pa.list_(pa.int64())), empty(m, pa.int32()), empty(m, pa.int64())], names)
    c = np.flatnonzero(n)
    m = len(c)
    yield pa.RecordBatch.from_arrays(
        [empty(m, pa.int64()), empty(m, pa.list_(pa.int64())), empty(m, pa.list_(pa.int32())), empty(m, pa.float64()), empty(m, pa.list_(pa.float64())), empty(m, pa.float64()),
         pa.array(c, pa.int32()), pa.array(n[c]), _lists(s[c], pa.int64()), pa.array([used] * m, pa.int32()), pa.array([scanned if i == 0 else 0 for i in range(m)], pa.int64())], names)


def _last(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = matrix(b.column(1), centroids.shape[1])
        cluster = _settled(b, x, centroids, drift, most).near[:, 0]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(paired(x, centroids[cluster]), pa.int64())], ["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, length: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", told: list | None = None) -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components count as floor(scale * x). Centroids start as the vectors of least sha256 of `seed:id`; each round assigns all
    vectors and replaces centroids by floored means, and vectors are assigned once more at the end. With each vector goes an
    upper bound for its own centroid, lower bounds for the next few (a quarter of all at first, then as many as a round has
    looked at, but an eighth at least) and one lower bound for the rest. Bounds move by what centroids have moved. Where they
    leave the nearest in doubt, exact integer distances decide, of tracked centroids first and of all if need be; so results are
    those of full scans. A round is one pass: each task writes its vectors with their bounds, and its sums behind them. told: gets
    the distances that each round computed, and the bounds that it kept.

    Nulls: vectors that are null, hold null or non-finite components or have another length than `length` are left out. Null ids have no
    hash and start no centroid while others can; ids that repeat are ordered by vector. Fewer vectors than k: as many
    centroids. Components too large for 64-bit distances are refused. Other columns are ignored. Empty table: no rows.
    """
    spark = vectors.sparkSession
    now = stored(integer_vectors(vectors, scale, id_col, vector_col, {}, length))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = first_rows(now, [digest.asc_nulls_last(), F.col("x").asc()], k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)
    most, drift = max(1, -(-k // 4)), None
    columns = ["id", "x"]
    for _ in range(rounds):
        run = lambda it, c=centroids, d=drift, m=most: _round(it, c, d, m)
        data = now.where("cluster is null") if drift is not None else now
        new = stored(data.select(*columns).mapInArrow(run, _STATE))
        drop_stored(now)
        sums = new.where("cluster is not null")
        looked = sums.agg(F.max("used").alias("used"), F.sum("scanned").alias("scanned")).first()
        if told is not None:
            told.append((looked["scanned"], most))
        moved = centroids.copy()
        for (c,), (n, s) in gathered(sums.select("cluster", "n", "sums"), ["cluster"]).items():
            moved[c] = [v // n for v in s]
        if drift is not None:
            most = max(-(-k // 8), min(most, looked["used"]))
        drift = above(np.sqrt(paired(moved, centroids).astype(np.float64)))
        centroids, now, columns = moved, new, ["id", "x", "near", "upper", "lower", "rest"]
    data = now.where("cluster is null") if rounds else now
    out = stored(data.select(*columns).mapInArrow(lambda it: _last(it, centroids, drift, most), "vec_id long, cluster int, distance long"))
    drop_stored(now)
    # as many rows as centroids
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    named = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
