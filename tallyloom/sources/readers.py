"""Strict readers: schemas are given, and files that drift from them fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.guards import GuardError, assert_unique


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, broken ones fail. Gzip is read as it is."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_shards(spark: SparkSession, paths: Sequence[str], schema: str, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """Shards as one table that names each row's file; repeated keys or a count other than the manifest's fail."""
    if not paths:
        raise GuardError("no shards")
    rows = read_jsonl(spark, list(paths), schema).withColumn("shard", F.col("_metadata.file_name"))
    missing = len(paths) - rows.select("shard").distinct().count()
    if missing > 0:
        raise GuardError(f"{missing} shards are empty or missing")
    if expected is not None and rows.count() != expected:
        raise GuardError("the rows differ from the manifest")
    return assert_unique(rows, keys)


def read_archive(spark: SparkSession, path: str, references: DataFrame, schema: str, key: str = "id") -> DataFrame:
    """A (gzipped) JSON document {records: {id: {...}}} as rows, with references joined late; a task that differs fails."""
    whole = spark.read.schema(f"records map<string, struct<{schema}>>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("records").alias(key, "r")).select(key, "r.*")
    joined = rows.join(references.withColumnRenamed("task", "_task"), key)
    wrong = F.raise_error(F.lit("task differs from the reference's")).cast("boolean")
    return joined.where(F.when(F.col("task") != F.col("_task"), wrong).otherwise(F.lit(True))).drop("_task")


def read_csv_strict(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """CSV whose header is exactly the schema's names (a byte-order mark is allowed); blank keys and empty files fail."""
    first = spark.read.text(path).limit(1).collect()
    names = first[0][0].lstrip("﻿").rstrip("\r").split(",") if first else []
    if names != schema.names:
        raise GuardError(f"the header is {names}")
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    if rows.limit(1).count() == 0:
        raise GuardError("no rows")
    blank = rows.where(F.greatest(*(F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True)) for k in keys), F.lit(False)))
    if blank.limit(1).count():
        raise GuardError("blank keys")
    return assert_unique(rows, keys)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Text files that begin with `key: value` lines up to a blank line: name, headers (map) and body."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    parts = files.select("name", F.split("v", "\n[ \t]*\n", 2).alias("p"))
    lines = F.filter(F.split(F.col("p")[0], "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"), F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("v")))
    unique = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == x["i"] + 1)
    return parts.select("name", F.map_from_entries(F.transform(unique, lambda x: F.struct(x["k"], x["v"]))).alias("headers"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("body"))


def read_zip_member(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """JSON lines of one member of each zip file."""

    def lines(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame({"value": [x for x in zipfile.ZipFile(io.BytesIO(content)).read(member).decode("utf-8-sig").splitlines() if x.strip()]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of each file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or differ (name, problem); none means all is well."""
    both = found.alias("f").join(expected.alias("e"), "name", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected").when(F.col("f.sha256") != F.col("e.sha256"), "differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def read_config(path: str) -> dict:
    """A JSON or YAML mapping; anything else fails."""
    import json
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise TypeError("a configuration is a mapping")
    return value
