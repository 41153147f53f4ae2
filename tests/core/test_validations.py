"""Places in an order, unpaired contrasts, frozen lists and amended categories."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators.guards import GuardError
from tallyloom.plans import validations as P


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered(spark, parts):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(3000)]
    got = R.numbered(spark.createDataFrame(rows, "a int, b int").repartition(parts), [F.desc("a"), F.col("b")], "at").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.at)] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(x.at for x in got) == list(range(3000))
    assert R.numbered(spark.createDataFrame([], "a int"), [F.col("a")], "at").count() == 0


def test_orders_of_whole_tables(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    want = sorted(range(100), key=lambda k: hashlib.sha256(f"5:{k}".encode()).hexdigest())
    assert [x.k for x in sorted(R.hash_rank(df, "k", [], 5).collect(), key=lambda x: x.rank)] == want
    turned = sorted(R.rotated(df, "k", ["a", "b", "c"], 5).collect(), key=lambda x: x.position)
    assert [x.k for x in turned] == want and [x.first_arm for x in turned[:4]] == ["a", "b", "c", "a"]
    assert {x.k: x.shard for x in R.sharded(df, "k", 7).collect()} == {k: k % 7 for k in range(100)}


def test_unpaired_shares(spark):
    r = random.Random(2)
    rows = [(f"p{r.randrange(9)}", r.random() < 0.5, r.randrange(4), 4) for _ in range(60)]
    pages = spark.createDataFrame(rows, "source string, fresh boolean, x int, m int").groupBy("source", "fresh").agg(F.sum("x").alias("x"), F.sum("m").alias("m")).withColumn("level", F.lit("all"))
    got = P.unpaired_shares(pages, ["level"], "x", "m", 300, (1, 2)).first()
    share = lambda side: sum(x for _, f, x, _ in rows if f == side) / sum(m for *_, f, _, m in [(s, f, x, m) for s, f, x, m in rows] if f == side)
    assert got.estimate == pytest.approx(share(True) - share(False), abs=2e-9)
    assert got.ci_low < got.estimate < got.ci_high
    assert (got.fresh_pages, got.old_pages) == tuple(len({s for s, f, *_ in rows if f == side}) for side in (True, False))


def test_frozen_lists(spark):
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    ids = spark.createDataFrame([(7,), (3,)], "k long")
    sha = hashlib.sha256(b"3\n7").hexdigest()
    assert [(x.k, x.v) for x in P.frozen(df, "k", ids, [F.col("k")], sha).collect()] == [(3, 6), (7, 14)]
    with pytest.raises(GuardError, match="other bytes"):
        P.frozen(df, "k", ids, [F.col("k")], "0" * 64)
    with pytest.raises(GuardError, match="is missing"):
        P.frozen(df, "k", spark.createDataFrame([(70,)], "k long"), [F.col("k")])
    with pytest.raises(GuardError, match="repeat"):
        P.frozen(df, "k", ids.union(ids), [F.col("k")])


def test_amended_categories(spark):
    rows = [("กี่", "EXACT_TARGET", "EXACT_TARGET"), ("ก�่", "OTHER_THAI", "OUTPUT_CONTRACT_FAILURE"), ("\r\nกี้", "OPPOSITE_MEMBER", "OPPOSITE_MEMBER"), ("", "EMPTY", "EMPTY"), ("�", "NON_THAI", "OUTPUT_CONTRACT_FAILURE"), (None, None, None)]
    was, now = P.amended(F.col("raw"), F.lit("กี่"), F.lit("กี้"))
    got = spark.createDataFrame([(r,) for r, *_ in rows], "raw string").select("raw", was, now).collect()
    by = defaultdict(tuple, {x[0]: (x[1], x[2]) for x in got})
    assert all(by[r] == (a, b) for r, a, b in rows[:-1])
