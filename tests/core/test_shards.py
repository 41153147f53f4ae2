"""Tables of shards: writes that fail, are killed or repeated; strict readers of runs and cases."""

import datetime
import decimal
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.guards import GuardError
from tallyloom.sources import shards as S

SCHEMA = "id long, text string, n int, x double, ok boolean, at timestamp, d decimal(10,2), raw binary, l array<struct<a:int,b:string>>, m map<string,int>"


def rows(lo, hi):
    one = lambda i: (i, f"línea {i}\n\"q\"", i % 7, i / 3, i % 2 == 0, datetime.datetime(2024, 5, 1, 3, i % 60), decimal.Decimal(i) / 4, bytes([i % 256, 0]), [(i, None), (None, "b")], {"k": i})
    return [one(i) for i in range(lo, hi)] + ([(hi, *[None] * 9)] if lo == 0 else [])


def table(spark, lo, hi, parts=4):
    return spark.createDataFrame(rows(lo, hi), SCHEMA).repartition(parts, "id")


def held(spark, path):
    return sorted(S.read_table(spark, path, SCHEMA, ["id"]).collect(), key=lambda r: r.id)


def listed(path):
    return json.loads((path / S.MANIFEST).read_text())["files"]


def test_a_table_comes_back_as_it_was(spark, tmp_path):
    at = tmp_path / "t"
    S.append_missing(table(spark, 0, 40), str(at), ["id"])
    assert held(spark, str(at)) == sorted(table(spark, 0, 40).collect(), key=lambda r: r.id)
    for f in listed(at):
        data = (at / f["name"]).read_bytes()
        assert (hashlib.sha256(data).hexdigest(), data.count(b"\n")) == (f["sha256"], f["rows"])
    assert held(spark, at.as_uri()) == held(spark, str(at))
    assert S.read_table(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert S.read_table(spark, str(at), SCHEMA, rows=41).count() == 41
    with pytest.raises(Exception, match="41 rows, not 40"):
        S.read_table(spark, str(at), SCHEMA, rows=40).collect()


def test_repeated_and_failed_writes_leave_one_copy(spark, tmp_path):
    at = tmp_path / "t"
    S.append_missing(table(spark, 0, 30), str(at), ["id"])
    S.append_missing(table(spark, 0, 30), str(at), ["id"])
    assert len(held(spark, str(at))) == 31
    broken = table(spark, 31, 60).withColumn("n", F.when(F.col("id") == 55, F.raise_error(F.lit("killed here")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="killed here"):
        S.append_missing(broken, str(at), ["id"])
    assert len(held(spark, str(at))) == 31
    # what a writer that was killed outright leaves is not read, and goes with the next commit
    orphan = at / "data" / "dead" / "x.jsonl"
    orphan.parent.mkdir()
    orphan.write_text(json.dumps({"id": 999}) + "\n")
    assert len(held(spark, str(at))) == 31
    S.append_missing(table(spark, 20, 60), str(at), ["id"])
    assert [r.id for r in held(spark, str(at))] == list(range(60))
    assert not orphan.exists()
    assert {f"{f['name']}" for f in listed(at)} == {p.relative_to(at).as_posix() for p in (at / "data").rglob("*.jsonl")}
    table(spark, 1, 5).write.format("shards").mode("overwrite").save(str(at))
    assert [r.id for r in held(spark, str(at))] == [1, 2, 3, 4]
    with pytest.raises(GuardError, match="repeat"):
        S.append_missing(table(spark, 0, 3).union(table(spark, 0, 3)), str(at), ["id"])


def test_shards_that_drift_fail(spark, tmp_path):
    at = tmp_path / "t"
    S.append_missing(table(spark, 0, 20), str(at), ["id"])
    first = at / listed(at)[0]["name"]
    data = first.read_bytes()
    first.write_bytes(data.replace(b"l\xc3\xadnea", b"l\xc3\xadneA", 1))
    with pytest.raises(Exception, match="differs from the manifest"):
        S.read_table(spark, str(at), SCHEMA).collect()
    first.write_bytes(data)
    assert S.read_table(spark, str(at), SCHEMA).count() == 21
    with pytest.raises(Exception, match="is no int"):
        S.read_table(spark, str(at), "id long, text int").collect()
    first.unlink()
    with pytest.raises(Exception, match="which is not there"):
        S.read_table(spark, str(at), SCHEMA).collect()
    with pytest.raises(Exception, match="schema must be given"):
        spark.read.format("shards").load(str(at))


def leg(path, ids, items, failures=(), manifest=True):
    path.mkdir(parents=True)
    (path / "records.jsonl").write_text("".join(json.dumps({"id": i, "prompt_kind": p, "v": 1}) + "\n\n" for i in ids for p in "ab"))
    if manifest:
        (path / "manifest.json").write_text(json.dumps({"items": items, "failures": list(failures)}, indent=1))


RECORD, KEYS = "id string, prompt_kind string, v int", ["id", "prompt_kind"]


def test_runs(spark, tmp_path):
    leg(tmp_path / "shard-0-of-2", ["x", "y"], 2)
    leg(tmp_path / "shard-1-of-2", ["z"], 2, ["w/a", "w/b"])
    records, manifests = S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=2, shards=2)
    assert records.count() == 6 and sorted(r["items"] for r in manifests.collect()) == [2, 2]
    with pytest.raises(S.UnfinishedError, match="shards missing: .*shard-2-of-3"):
        S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=2, shards=3)
    with pytest.raises(GuardError, match="4 records, its manifest implies 2"):
        S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=1)
    leg(tmp_path / "more", ["x"], 1)
    with pytest.raises(GuardError, match="repeat"):
        S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=2)
    leg(tmp_path / "open", ["q"], 1, manifest=False)
    with pytest.raises(S.UnfinishedError, match="no manifest.json in .*open"):
        S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=2)
    (tmp_path / "nothing").mkdir()
    with pytest.raises(S.UnfinishedError, match="no records"):
        S.read_runs(spark, str(tmp_path / "nothing"), RECORD, KEYS)


def test_an_empty_shard_counts(spark, tmp_path):
    leg(tmp_path / "shard-0-of-2", ["x"], 1)
    leg(tmp_path / "shard-1-of-2", [], 1, ["f/a", "f/b"])
    assert S.read_runs(spark, str(tmp_path), RECORD, KEYS, per_item=2, shards=2)[0].count() == 2


def test_cases(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    at = tmp_path / "a" / "b" / "t3_cases.json"
    at.write_text(json.dumps({"cases": [{"id": "é", "line": 1}, {"id": "f", "line": None}], "other": 1}))
    sha = hashlib.sha256(at.read_bytes()).hexdigest()
    got = S.read_cases(spark, str(tmp_path), "t3_cases.json", "id:string,line:int", sha).collect()
    assert [(r.id, r.line) for r in got] == [("é", 1), ("f", None)]
    with pytest.raises(GuardError, match="has SHA-256"):
        S.read_cases(spark, str(tmp_path), "t3_cases.json", "id:string", "0" * 64)
    (tmp_path / "t3_cases.json").write_text('{"cases": []}')
    with pytest.raises(GuardError, match="expected one"):
        S.read_cases(spark, str(tmp_path), "t3_cases.json", "id:string")
    with pytest.raises(GuardError, match="found \\[\\]"):
        S.read_cases(spark, str(tmp_path), "t4_cases.json", "id:string")
