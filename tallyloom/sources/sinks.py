"""Writers that refuse to overwrite, and the small files of a report."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str, format_: str = "parquet", **options: Any) -> None:
    """Fails if there is anything at the path."""
    df.write.mode("errorifexists").format(format_).options(**options).save(path)


def write_rows_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV file of some columns in a fixed order; for small results that another tool reads."""
    df.select(*columns).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_archive(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Gzipped JSON lines of the named columns only."""
    df.select(*columns).write.mode("errorifexists").option("compression", "gzip").json(path)


def atomic_write_json(path: str, value: Any) -> None:
    """Whole or not at all: written beside the target and moved over it."""
    at, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(at, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(temporary, path)


def canonical_hash(value: Any) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def report(df: DataFrame) -> list[dict]:
    """A small result as JSON values, in the order of its columns; infinite numbers as 'inf'."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()
    return [{k: "inf" if v == "Infinity" else v for k, v in json.loads(r[0]).items()} for r in rows]
