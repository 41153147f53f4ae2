"""JSON lines in shards that a manifest vouches for: a data source whose writes are there once and whole, and strict readers of runs.

A table is a folder with `manifest.json` and `data/<write>/<part>.jsonl`. The manifest lists each file with its rows and SHA-256 and is
replaced in one step, so it is what commits a write: files that it does not list do not exist to a reader, whatever a killed writer left.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallyloom.operators.guards import GuardError, assert_unique

MANIFEST = "manifest.json"


def _open(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), os.path.abspath(path))


def read_manifest(path: str) -> dict:
    """The manifest of a table; of a folder without one, an empty table's, as nothing was committed there."""
    fs, root = _open(path)
    at = posixpath.join(root, MANIFEST)
    if fs.get_file_info(at).type == pf.FileType.NotFound:
        return {"files": []}
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def _value(x):
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    if isinstance(x, T.Row):
        return {k: _value(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): _value(v) for k, v in x.items()}
    return [_value(v) for v in x] if isinstance(x, (list, tuple)) else x


def _typed(x, kind: T.DataType):
    """A value of JSON as its column's type; one of another type fails."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(x.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in x]
    if isinstance(kind, T.MapType):
        return {k: _typed(v, kind.valueType) for k, v in x.items()}
    if isinstance(kind, T.TimestampType):
        return datetime.datetime.fromisoformat(x)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(x)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(x)
    if isinstance(kind, T.BinaryType):
        return bytes.fromhex(x)
    wanted = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.IntegerType: int, T.ShortType: int, T.ByteType: int}.get(type(kind), (int, float))
    if not isinstance(x, wanted) or isinstance(x, bool) != (wanted is bool):
        raise GuardError(f"{x!r} is no {kind.simpleString()}")
    return float(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x


class Shard(InputPartition):
    def __init__(self, name: str, rows: int, sha256: str):
        self.name, self.rows, self.sha256 = name, rows, sha256


class ShardReader(DataSourceReader):
    """A partition for each listed file. A shard that is missing fails when the read is planned; one that has other bytes or rows than
    the manifest says fails its task, and with it the query."""

    def __init__(self, path: str, schema: T.StructType, expected: int | None):
        self.path, self.schema, self.expected = path, schema, expected

    def partitions(self) -> Sequence[Shard]:
        fs, root = _open(self.path)
        files = read_manifest(self.path)["files"]
        for f, info in zip(files, fs.get_file_info([posixpath.join(root, f["name"]) for f in files]), strict=True):
            if info.type != pf.FileType.File:
                raise GuardError(f"the manifest lists {f['name']}, which is not there")
        rows = sum(f["rows"] for f in files)
        if self.expected is not None and rows != self.expected:
            raise GuardError(f"the manifest has {rows} rows, not {self.expected}")
        return [Shard(f["name"], f["rows"], f["sha256"]) for f in files]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if partition is None:  # a table without files has one empty partition
            return
        fs, root = _open(self.path)
        digest, n = hashlib.sha256(), 0
        with fs.open_input_file(posixpath.join(root, partition.name)) as f:
            for line in io.BufferedReader(f, 1 << 20):
                digest.update(line)
                n += 1
                record = json.loads(line)
                yield tuple(_typed(record.get(c.name), c.dataType) for c in self.schema)
        if n != partition.rows or digest.hexdigest() != partition.sha256:
            raise GuardError(f"{partition.name} differs from the manifest")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class ShardWriter(DataSourceWriter):
    """A task's rows go to a file of their own, each as soon as it comes, under a folder of this write. The manifest that names the files
    of all tasks is put in place once they are all there. Files of writes that never got so far are deleted then.

    A task that is run again writes another file, and only the one of the attempt that Spark commits is listed. There is one writer
    at a time.
    """

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> Written:
        fs, root = _open(self.path)
        name, digest, n = f"data/{self.job}/{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0
        at = posixpath.join(root, name)
        fs.create_dir(posixpath.dirname(at), recursive=True)
        with fs.open_output_stream(at) as f:
            for row in iterator:
                line = (json.dumps({k: _value(v) for k, v in zip(self.names, row, strict=True)}, ensure_ascii=False) + "\n").encode()
                f.write(line)
                f.flush()
                digest.update(line)
                n += 1
        return Written(name, n, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        files = [] if self.overwrite else read_manifest(self.path)["files"]
        files += [{"name": m.name, "rows": m.rows, "sha256": m.sha256} for m in messages if m and m.rows]
        fs.create_dir(root, recursive=True)
        new = posixpath.join(root, f".{self.job}")
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"files": sorted(files, key=lambda x: x["name"])}, indent=1).encode())
        fs.move(new, posixpath.join(root, MANIFEST))
        held = {posixpath.join(root, x["name"]) for x in files}
        for info in fs.get_file_info(pf.FileSelector(posixpath.join(root, "data"), recursive=True, allow_not_found=True)):
            if info.type == pf.FileType.File and info.path not in held:
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        at = posixpath.join(root, "data", self.job)
        if fs.get_file_info(at).type == pf.FileType.Directory:
            fs.delete_dir(at)


class ShardSource(DataSource):
    """Format `shards`. Options: path; rows: how many the manifest must have, if that is known."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise GuardError("a table of shards needs a path")
        return path

    def schema(self) -> str:
        raise GuardError("a schema must be given: strict tables infer none")

    def reader(self, schema: T.StructType) -> ShardReader:
        rows = self.options.get("rows")
        return ShardReader(self._path(), schema, None if rows is None else int(rows))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self._path(), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """A table of shards; keys that repeat fail."""
    register(spark)
    reader = spark.read.format("shards").schema(schema)
    out = (reader if rows is None else reader.option("rows", rows)).load(path)
    return assert_unique(out, keys) if keys else out


def append_missing(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Adds the rows whose keys the table lacks, so that a write that was killed or is repeated is made up for and nothing is there twice."""
    spark = df.sparkSession
    register(spark)
    there = spark.read.format("shards").schema(df.schema).load(path).select(*keys)
    assert_unique(df, keys).join(there, list(keys), "left_anti").write.format("shards").mode("append").save(path)


# Runs that other tools have written --------------------------------------------------------------------------------------------------


class UnfinishedError(GuardError):
    pass


def read_runs(spark: SparkSession, root: str, schema: str, keys: Sequence[str], per_item: int = 1, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of all folders under root that hold `records.jsonl`, and their manifests (folder, items, failures).

    Fails if there is none, a folder has no `manifest.json` (its run did not end), one has other than items * per_item records less its
    failures, keys repeat, or, with `shards`, any of shard-0-of-n to the last is missing or another is there. Spark does not list empty
    files, so a folder is known by its manifest, too.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "")
    at = lambda name: spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True)
    files = at("records.jsonl").format("binaryFile").load(root).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
    records = at("records.jsonl").schema(schema).option("mode", "FAILFAST").json(root).withColumn("folder", folder)
    manifests = at("manifest.json").option("multiLine", True).schema("items long, failures array<string>").option("mode", "FAILFAST").json(root).withColumn("folder", folder)
    plain = lambda df: df.withColumn("folder", F.regexp_replace("folder", "^file:/+", "/"))
    files, records, manifests = plain(files), plain(records), plain(manifests)
    counts = files.join(records.groupBy("folder").agg(F.count("*").alias("records")), "folder", "left").join(manifests, "folder", "full_outer")
    found = counts.select("folder", F.coalesce("records", F.lit(0)).alias("records"), "items", F.size(F.coalesce("failures", F.array().cast("array<string>"))).alias("failed"), F.col("items").isNotNull().alias("ended")).collect()  # one row a folder
    if not found:
        raise UnfinishedError(f"{root}: no records")
    if open_ := sorted(r["folder"] for r in found if not r["ended"]):
        raise UnfinishedError(f"no {MANIFEST} in {open_}")
    if shards is not None:
        there = {r["folder"].rsplit("/", 1)[-1] for r in found}
        wanted = {f"shard-{k}-of-{shards}" for k in range(shards)}
        if there != wanted:
            raise UnfinishedError(f"shards missing: {sorted(wanted - there)}, unexpected: {sorted(there - wanted)}")
    for r in found:
        if r["records"] != r["items"] * per_item - r["failed"]:
            raise GuardError(f"{r['folder']}: {r['records']} records, its manifest implies {r['items'] * per_item - r['failed']}")
    return assert_unique(records, keys), manifests


def read_cases(spark: SparkSession, root: str, name: str, case: str, sha256: str | None = None) -> DataFrame:
    """The cases of the one file of that name anywhere under root, {"cases": [...]}; none, several, or other bytes than expected fail."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(root)
    found = files.select("path", F.sha2("content", 256).alias("sha256")).limit(3).collect()
    if len(found) != 1:
        raise GuardError(f"expected one {name} under {root}, found {[r['path'] for r in found]}")
    if sha256 is not None and found[0]["sha256"] != sha256:
        raise GuardError(f"{name} has SHA-256 {found[0]['sha256']}")
    parsed = files.select(F.from_json(F.col("content").cast("string"), f"cases array<struct<{case}>>", {"mode": "FAILFAST"}).alias("c"))
    return parsed.select(F.explode("c.cases").alias("c")).select("c.*")
