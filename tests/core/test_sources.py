"""Readers fail closed; sinks refuse to overwrite; streams resume."""

import gzip
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import guards as G
from tallyloom.operators import resample as B
from tallyloom.plans.statistics import binomial_upper
from tallyloom.sources import readers as R
from tallyloom.sources import sinks as S
from tallyloom.streaming import watch as W


def test_jsonl_and_shards(spark, tmp_path):
    for k in (0, 1):
        (tmp_path / f"s{k}.jsonl").write_text("".join(json.dumps({"id": f"{k}{i}", "v": i}) + "\n\n" for i in range(3)))
    paths = [str(tmp_path / f"s{k}.jsonl") for k in (0, 1)]
    assert R.read_shards(spark, paths, "id string, v long", ["id"], 6).count() == 6
    with pytest.raises(G.GuardError):
        R.read_shards(spark, paths, "id string, v long", ["id"], 7)
    with pytest.raises(G.GuardError):
        R.read_shards(spark, paths, "id string, v long", ["v"])


def test_archive(spark, tmp_path):
    p = tmp_path / "a.json.gz"
    p.write_bytes(gzip.compress(json.dumps({"records": {"a": {"task": "x", "out": "1"}, "b": {"task": "y", "out": "2"}}}).encode()))
    refs = spark.createDataFrame([("a", "x", "r")], "id string, task string, reference string")
    assert [tuple(r) for r in R.read_archive(spark, str(p), refs, "task: string, out: string").select("id", "out", "reference").collect()] == [("a", "1", "r")]
    with pytest.raises(Exception, match="task differs"):
        R.read_archive(spark, str(p), refs.withColumn("task", F.lit("z")), "task: string, out: string").collect()


def test_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "g.csv").write_text("﻿image_id,n\na,1\nb,2\n", encoding="utf-8")
    assert R.read_csv_strict(spark, str(tmp_path / "g.csv"), schema, ["image_id"]).count() == 2
    for name, text in (("drift", "image,n\na,1\n"), ("blank", "image_id,n\n,1\n"), ("empty", "image_id,n\n"), ("twice", "image_id,n\na,1\na,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(G.GuardError):
            R.read_csv_strict(spark, str(tmp_path / f"{name}.csv"), schema, ["image_id"])


def test_messages_zip_and_digests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/one.txt").write_text("From: ann\nTo: bo: x\nFrom: twice\n\nbody\n\nmore")
    r = R.read_messages(spark, str(tmp_path / "m")).first()
    assert r.headers == {"from": "ann", "to": "bo: x"} and r.body == "body\n\nmore"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("rows.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert R.read_zip_member(spark, str(tmp_path / "b.zip"), "rows.jsonl", "a long").agg(F.sum("a")).first()[0] == 3
    found = R.file_digests(spark, str(tmp_path / "m"))
    sha = hashlib.sha256((tmp_path / "m/one.txt").read_bytes()).hexdigest()
    assert R.verify_digests(found, spark.createDataFrame([("one.txt", sha)], "name string, sha256 string")).count() == 0
    bad = R.verify_digests(found, spark.createDataFrame([("one.txt", "0"), ("two.txt", "0")], "name string, sha256 string"))
    assert sorted(map(tuple, bad.collect())) == [("one.txt", "differs"), ("two.txt", "missing")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf"))], "a long, b double")
    S.write_once(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_once(df, str(tmp_path / "x"))
    assert S.report(df) == [{"a": 1, "b": "inf"}]
    S.atomic_write_json(str(tmp_path / "r.json"), {"k": 1})
    assert R.read_config(str(tmp_path / "r.json")) == {"k": 1}
    assert S.canonical_hash({"b": 1, "a": 2}) == S.canonical_hash({"a": 2, "b": 1})


def test_guards(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k long, v string")
    with pytest.raises(G.GuardError):
        G.assert_unique(df, ["k"])
    with pytest.raises(G.GuardError):
        G.assert_grain(df, ["k"], 2)
    with pytest.raises(G.GuardError):
        G.assert_one_cell(df, ["v"])
    with pytest.raises(G.GuardError):
        G.assert_same_keys(df, df.where("k = 1"), ["k"])
    with pytest.raises(G.GuardError):
        G.assert_disjoint(df, df, ["k"])


def test_inference(spark):
    assert abs(binomial_upper(0, 100) - (1 - 0.05 ** 0.01)) < 1e-9 and binomial_upper(5, 5) == 1.0 and binomial_upper(0, 0) is None
    same = spark.createDataFrame([(f"c{i}", 0.0) for i in range(20)], "c string, v double")
    r = B.ratio_interval(same, "c", [], F.col("v"), F.lit(1), 50, 1).first()
    assert (r.estimate, r.ci_low, r.ci_high) == (0, 0, 0)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", 0.03)], "k string, p double")
    assert {x.k: x.p_holm for x in B.holm(p, "p").collect()} == {"a": 0.03, "b": 0.06, "c": None, "d": 0.06}


def test_streams(spark, tmp_path):
    from datetime import datetime

    src = tmp_path / "in"
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "k", 1.0) for m in range(25)], "ts timestamp, k string, v double").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(src))
    q = W.windowed_totals(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("totals").collect()) == [5, 10, 10]
    batch = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    for _ in range(2):
        W.append_new(batch, str(tmp_path / "out"), ["id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
