"""Rules of pairs and answers against hand-worked cases, main effects against least squares, the covariance against plain products."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import audits as A


def test_pairs_and_answers(spark):
    rows = [
        ("กา", "ขา", A.RULES[0], ""), ("กา", "กา", A.RULES[0], "DIFFERENCE_RULE_MISMATCH,IDENTICAL_STRINGS"), ("กา", "ก่า", A.RULES[1], ""), ("กา", "ก้า", A.RULES[1], "DIFFERENCE_RULE_MISMATCH"),
        ("กิน", "กีน", A.RULES[2], ""), ("กิน", "กุน", A.RULES[2], "DIFFERENCE_RULE_MISMATCH"), ("กุน", "กูน", A.RULES[3], ""), ("กี", "กี่", A.RULES[4], ""), ("กา", "ก่า", A.RULES[4], "DIFFERENCE_RULE_MISMATCH"),
        ("", "ก่", A.RULES[1], "DIFFERENCE_RULE_MISMATCH,EMPTY_STRING"), ("ก", "ax", "OTHER", "NON_THAI_CODEPOINT_B,UNKNOWN_DIFFERENCE_RULE"), ("ก่ี", "ก", "OTHER", "NONCANONICAL_MARK_ORDER_A,UNKNOWN_DIFFERENCE_RULE"),
    ]
    at = spark.createDataFrame(rows, "a string, b string, rule string, want string")
    yes = F.lit(True)
    for x in at.select("*", F.array_join(A.pair_issues(F.col("a"), F.col("b"), F.col("rule"), yes, yes), ",").alias("got")).collect():
        assert x.got == x.want, x
    answers = [
        ("กา", "กา", "ขา", 0, "correct_target", True), ("ขา", "กา", "ขา", 0, "opposite_member_substitution", False), ("", "กา", "ขา", 0, "deletion", False), ("กา\nx", "กา", "ขา", 0, "output_contract_failure", True),
        ("ข่", "ก่า", "กา", 1, "other_substitution", True), ("กิ", "ปิ", "ปี", 2, "other_substitution", True), ("กิี", "ปิ", "ปี", 2, "other_substitution", False), ("กู", "กู", "กุ", 3, "correct_target", True),
        ("ปี", "ปี่", "ปี", 4, "opposite_member_substitution", False), ("xี่", "ปี่", "ปี", 4, "other_substitution", True), ("ปา", "ปา", "ปี", 4, "correct_target", False),
    ]
    at = spark.createDataFrame([(o, a, b, A.COMPONENTS[k], t, c) for o, a, b, k, t, c in answers], "o string, a string, b string, component string, t string, c boolean")
    for x in at.select("*", A.taxonomy(F.col("o"), F.col("a"), F.col("b")).alias("got"), A.component_correct(F.col("o"), F.col("a"), F.col("component")).alias("right")).collect():
        assert (x.got, x.right) == (x.t, x.c), x
    with pytest.raises(Exception, match="unknown component"):
        at.select(A.component_correct(F.col("o"), F.col("a"), F.lit("NONE"))).collect()


def test_main_effects(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc") if i % 9 else None, r.randrange(3), r.random()) for i in range(200)] + [(200, "a", 1, None)]
    got = {x.id: x.residual for x in A.main_effects(spark.createDataFrame(rows, "id long, f string, g int, y double"), ["f", "g"], "y").collect()}
    fit = rows[:200]
    design = np.column_stack([np.ones(200)] + [[float(x[k] == level) for x in fit] for k, levels in ((1, ("a", "b", "c")), (2, (1, 2))) for level in levels])
    y = np.array([x[3] for x in fit])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert len(got) == 201 and got[200] is None and all(abs(got[i] - want[i]) < 1e-9 for i in range(200))
    assert A.main_effects(spark.createDataFrame([], "id long, f string, y double"), ["f"], "y").collect() == []


def test_covariance_and_curve(spark, tmp_path):
    from tallyloom.plans.registry import QUERIES

    r = random.Random(6)
    days = [f"199{n}-02-03" for n in range(3)]
    orders = [(i, i % 12, r.choice("ab"), r.choice("FO"), r.choice(days), r.uniform(1, 9)) for i in range(240)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, d string, o_totalprice double").withColumn("o_orderdate", F.to_date("d")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, c // 2 % 3) for c in range(12)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["GLM2_AGG62_BOO22_residual_covariance"](spark, str(tmp_path)).collect()[0]
    dummies = [np.ones(240)] + [np.array([float(f(o) == v) for o in orders]) for f, values in ((lambda o: o[2], "b"), (lambda o: o[3], "O"), (lambda o: o[4], days[1:]), (lambda o: o[0] % 2, [1])) for v in values]
    y = np.log([o[5] for o in orders])
    e = y - np.column_stack(dummies) @ np.linalg.lstsq(np.column_stack(dummies), y, rcond=None)[0]
    of = lambda nation, m: [e[i] for i, o in enumerate(orders) if o[1] // 2 % 3 == nation and i % 2 == m]
    within = np.mean([np.mean([a * b for m in (0, 1) for a, b in itertools.permutations(of(n, m), 2)]) for n in range(3)])
    cross = np.mean([np.mean([a * b for a in of(n, 0) for b in of(n, 1)]) for n in range(3)])
    assert got.pairs == 3 and abs(got.within - within) < 1e-8 and abs(got.cross - cross) < 1e-8 and abs(got.excess - (within - cross)) < 1e-8 and got.ci_low <= got.median <= got.ci_high
    events = [(u, f"e{k}", float(r.randrange(100))) for u in range(30) for k in range(4)]
    spark.createDataFrame(events, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    hits = {u: {k for v, k, x in events if v == u and x > 80} for u in range(30)}
    for x in QUERIES["AGG43_all_subsets_curve"](spark, str(tmp_path)).collect():
        sets = list(itertools.combinations([f"e{k}" for k in range(4)], x.k))
        assert x.subsets == len(sets) and abs(x.share - np.mean([bool(hits[u] & set(s)) for u in hits for s in sets])) < 1e-8
