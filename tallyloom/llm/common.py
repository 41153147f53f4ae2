"""Helpers shared by the training-data operators: shared storage, size-checked broadcasts and text units."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space the query contracts name, as a Java regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"

#: A side with at most this many rows (of some tens of bytes each) may be broadcast; beyond it, Spark joins by shuffle.
BROADCAST_ROWS = 200_000

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(at)
    return at


#: Bytes of text that Spark sends to Python at a time, at most, beside one row that has more.
BATCH_BYTES = 8 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Let Spark send at most BATCH_BYTES to Python at a time, from now on in this session; a lower setting stays.

    A batch is held by the executor's JVM and by its Python at once, in buffers that grow by doubling and stay with both.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return the memory that this Python process holds free to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{uuid.uuid4().hex}"
    begun = time.monotonic()
    df.write.option("compression", codec).parquet(path)
    if time.monotonic() - begun > 2:
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the plan that has just ended
    _kept.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write df in the shared folder, dealt by a hash of the key, and read it back: joins on the key move only their other side."""
    spark = df.sparkSession
    name = f"tallyloom_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/tallyloom/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    spark.sparkContext._jvm.System.gc()
    _kept.append((spark, path))
    out = spark.table(name)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by stored() that no plan still to run reads."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    _kept.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the shared folder's owner cleans up
            return


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within the limit."""
    return F.broadcast(df) if rows <= limit else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class WordHashes(dict):
    """64-bit hash of each word (bytes), kept for words seen; emptied when it holds too many."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the rolling polynomials.
BASE = 0x9E3779B97F4A7C15


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of n values, modulo 2**64, by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, block, width, factor = None, 0, None, h, 1, np.uint64(BASE)
        while True:
            if n & width:
                if out is None:
                    out, done = block, width
                else:  # out covers the first `done` values, block the next `width`
                    m = len(h) - done - width + 1
                    out, done = out[:m] * factor + block[done : done + m], done + width
            if done == n:
                return out[: len(h) - n + 1]
            block = block[: len(block) - width] * factor + block[width:]
            factor = factor * factor
            width *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order is unrelated to the polynomial's."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
