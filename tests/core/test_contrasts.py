"""Contrast families against plain definitions: unions of views, panels, arms, marginal groups, rank correlations under draws."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import contrasts as C
from tallyloom.operators import resample as B
from tallyloom.plans import contrasts as P
from tallyloom.plans import rules


def lines(r, pages=7, per=9, views=("a", "b", "c")):
    return [(f"p{p}", f"{p}-{k}", v, g, m, r.choice(["text", "figure_only", "not_found"])) for p in range(pages) for k in range(per) for g, m in [(r.choice(["absent", "absent", "control"]), r.randrange(6))] for v in views]


KIND = "page string, line string, view string, group string, marks int, outcome string"


def test_unions_of_views_under_draws(spark):
    rows = lines(random.Random(1))
    counts = C.mask_counts(spark.createDataFrame(rows, KIND), "page", "line", ["a", "b", "c"]).where("group = 'absent'")
    effects = {"union_ab": F.expr("case when (text & 3) <> 0 then 1 else 0 end"), "c_not_a": F.expr("case when (text & 4) <> 0 and (text & 1) = 0 then 1 else 0 end"), "any_b": F.expr("case when ((text | figure) & 2) <> 0 then 1 else 0 end")}
    got = {r.effect: r for r in C.mask_bootstrap(counts, "page", effects, 300, 5).collect()}
    read, marks = defaultdict(dict), {}
    for page, line, view, group, m, outcome in rows:
        if group == "absent":
            read[page, line][view] = outcome
            marks[page, line] = m
    hit = {"union_ab": lambda o: "text" in (o["a"], o["b"]), "c_not_a": lambda o: o["c"] == "text" != o["a"], "any_b": lambda o: o["b"] != "not_found"}
    pages = sorted({p for p, _ in read})
    by_draw = defaultdict(list)
    numbered = spark.createDataFrame([(p, k, len(pages)) for k, p in enumerate(pages)], "page string, _k int, _m int")
    for x in B.plan(numbered, [], 300, 5).collect():
        by_draw[x.draw] += [pages[x._k]] * x.weight
    for name, f in hit.items():

        def share(chosen, f=f):
            lines_ = [k for p in chosen for k in read if k[0] == p]
            total = sum(marks[k] for k in lines_)
            return round(sum(marks[k] for k in lines_ if f(read[k])) / total, 9) if total else 0.0

        v = sorted(share(d) for d in by_draw.values())
        assert len(v) == 300
        assert (got[name].estimate, got[name].ci_low, got[name].ci_high) == pytest.approx((share(pages), v[7], v[291]), abs=1e-9)


def test_views_that_disagree_fail_the_plan(spark):
    rows = lines(random.Random(2))
    for spoilt in (rows[1:], [*rows, rows[0]], [(*rows[0][:4], 99, rows[0][5]), *rows[1:]], [(*rows[0][:2], "x", *rows[0][3:]), *rows[1:]]):
        with pytest.raises(Exception, match="views disagree on a line of page p0"):
            C.mask_counts(spark.createDataFrame(spoilt, KIND), "page", "line", ["a", "b", "c"]).collect()
    assert C.mask_counts(spark.createDataFrame([], KIND), "page", "line", ["a"]).count() == 0


def panel(wrong=frozenset()):
    return [(f"s{p:03}", m, b, k, 0 if (m, b) == ("BASE", "B64") and p in wrong else 1) for p in range(100) for m in P.MODELS for b in P.BUDGETS for k in range(8)]


ROWS = "source string, model string, budget string, render int, ok int"


def test_panel_with_a_planted_effect(spark):
    table = P.panel_vectors(spark.createDataFrame(panel(range(20)), ROWS))
    point, draws = C.drawn_means(table, "source", list(P.DIDS), 400, 3)
    got = {r.contrast: r for r in C.family(point, draws, list(P.DIDS), list(P.DIDS)).collect()}
    assert got["DID_64"].estimate == pytest.approx(0.20) and 0.05 < got["DID_64"].ci_low < 0.20 < got["DID_64"].ci_high < 0.35
    assert (got["DID_196"].estimate, got["DID_196"].ci_low, got["DID_196"].ci_high, got["DID_196"].p) == (0, 0, 0, 1)
    assert got["DID_64"].p_holm == pytest.approx(min(1, 3 * got["DID_64"].p)) and got["DID_64"].reject
    k = C.covariances(draws, list(P.DIDS)).first()
    names = list(P.DIDS)
    cov = [[k[f"cov_{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(3)] for i in range(3)]
    assert cov == pytest.approx(np.cov(np.array([[r[n] for n in names] for r in draws.collect()]), rowvar=False))
    assert rules.wald_of([0, 0, 0.2], cov) == ("FALLBACK_GLOBAL_TEST_NOT_ESTIMABLE", None, None)


def test_wald_of_a_known_covariance():
    status, statistic, p = rules.wald_of([1.0, 2.0, 0.5], np.diag([1.0, 4.0, 0.25]))
    assert (status, statistic) == ("ESTIMABLE", pytest.approx(3.0)) and p == pytest.approx(0.3916252, abs=1e-6)
    assert rules.wald_of([1.0], [[float("nan")]])[0] == "FALLBACK_GLOBAL_TEST_NOT_ESTIMABLE"


def test_panels_of_other_grain_fail_the_plan(spark):
    rows = panel()
    for spoilt in (rows[1:], [*rows, rows[0]]):
        with pytest.raises(Exception, match="a cell has other items than it must: s000"):
            P.panel_vectors(spark.createDataFrame(spoilt, ROWS)).collect()
    with pytest.raises(Exception, match="missing in pair s000"):
        P.panel_vectors(spark.createDataFrame(rows[8:], ROWS)).collect()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, condition_id string, cer double")


def test_arm_families_and_their_states(spark):
    conditions = ["FULL"] + [f"{a}_{v}" for a in "AB" for v in P.LEVELS]
    rows = [(i, f"s{i // 2}", c, 0.0 if c == "FULL" else 1 / 3) for i in range(8) for c in conditions]
    rows += [(50, "s9", c, 0.5) for c in conditions if c != "B_25"]  # not complete
    families = {**P.FAMILIES, "ALONE": ("A", None, True, False)}
    got = {(r.family, r.budget): r for r in P.contrast_families(table(spark, rows), families, draws=100, seed=1).collect()}
    did = got["DID", "50"]
    assert (did.status, did.regions, did.clusters, did.estimate, did.ci_low, did.ci_high, did.p, did.p_holm) == ("ANALYSED", 8, 4, 0, 0, 0, 1, 1)
    marginal = got["MARGINAL_A", "25"]  # needs A only, so the incomplete region takes part: 8 thirds and a 0
    assert (marginal.regions, marginal.clusters) == (9, 5) and marginal.estimate == pytest.approx(8 / 27)
    assert got["CONTRAST_C_A", None].status == "CONDITIONS_NOT_PRESENT" and got["ALONE", "75"].p_holm is None
    worse = [(i, s, c, 0.1 if c == "FULL" else x) for i, s, c, x in rows]
    states = {(r.family, r.status) for r in P.contrast_families(table(spark, worse), P.FAMILIES, draws=50, seed=1).collect()}
    assert ("DID_FULL_ZERO", "NO_COMPLETE_ROWS") in states and ("DID", "ANALYSED") in states
    assert {r.status for r in P.contrast_families(table(spark, []), P.FAMILIES, draws=50, seed=1).collect()} == {"CONDITIONS_NOT_PRESENT"}


def test_marginal_groups_and_their_draws(spark):
    r = random.Random(6)
    rows = [(f"p{r.randrange(6)}", r.choice("xy"), r.choice([1, 2, None]), r.randrange(10)) for _ in range(200)] + [("p9", "x", 1, 4)]
    df = spark.createDataFrame(rows, "pair string, a string, b int, v int")
    kinds = {"all": (), "a": ("a",), "ab": ("a", "b")}
    groups = C.marginal_groups(df, "pair", kinds, {"s": F.col("v"), "n": F.lit(1)})
    label = lambda kind, row: "|".join("" if row[1 + "ab".index(c)] is None else str(row[1 + "ab".index(c)]) for c in kinds[kind]) or "all"
    want = Counter()
    for row in rows:
        for kind in kinds:
            want[kind, label(kind, row), row[0]] += row[3]
    assert {(x.kind, x.level, x.pair): x.s for x in groups.collect()} == dict(want)
    point, v = C.group_draws(groups, "pair", {"mean": ("s", "n")}, 200, 9)
    means = {(x.kind, x.level): x for x in point.collect()}
    drawn = defaultdict(dict)
    for x in v.collect():
        drawn[x.kind, x.level][x.draw] = x.v
    for kind, level in means:
        own = [row for row in rows if label(kind, row) == level]
        assert means[kind, level].estimate == pytest.approx(sum(x[3] for x in own) / len(own), abs=1e-9)
        assert means[kind, level].pairs == len({x[0] for x in own}) and len(drawn[kind, level]) == 200
    # groups with the same clusters have the same plan: an average of both levels of a sum is in the draws of all, too
    one = C.group_draws(groups.where("kind = 'a' and level = 'x'").withColumn("kind", F.lit("copy")).unionByName(groups.where("kind = 'a' and level = 'x'")), "pair", {"mean": ("s", "n")}, 50, 9)[1].collect()
    by = defaultdict(set)
    for x in one:
        by[x.draw].add(x.v)
    assert all(len(s) == 1 for s in by.values())


def test_paired_levels(spark):
    rows = [("p1", 1, 4.0), ("p1", 1, 6.0), ("p1", 2, 1.0), ("p2", 1, 1.0), ("p2", 2, 1.0)]
    kinds = {"k": (F.col("v"), F.col("l") == 1, F.col("l") == 2)}
    df = spark.createDataFrame(rows, "pair string, l int, v double")
    assert sorted((x.pair, x.v) for x in C.paired_differences(df, "pair", kinds).collect()) == [("p1", 4.0), ("p2", 0.0)]
    with pytest.raises(Exception, match="a level of k is missing in pair p2"):
        C.paired_differences(df.where("not (pair = 'p2' and l = 2)"), "pair", kinds).collect()


def ranks(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def rho(rows):
    if len(rows) < 3 or len({x for x, _ in rows}) == 1 or len({y for _, y in rows}) == 1:
        return None
    return float(np.corrcoef(ranks([x for x, _ in rows]), ranks([y for _, y in rows]))[0, 1])


def test_rank_correlation_of_weighted_rows(spark):
    r = random.Random(8)
    rows = [(g, r.randrange(4), r.randrange(5), r.randrange(4)) for g in "uvw" for _ in range(12)] + [("one", 1, 1, 2), ("flat", 1, 1, 2), ("flat", 1, 2, 5)]
    got = {x.g: x.rho for x in C.rank_correlation(spark.createDataFrame(rows, "g string, x int, y int, w int"), "w", ["g"]).collect()}
    for g, value in got.items():
        want = rho([(x, y) for k, x, y, w in rows if k == g for _ in range(w)])
        assert value == (None if want is None else pytest.approx(want, abs=1e-8))


def test_spearman_equals_ranks_of_materialised_draws(spark):
    r = random.Random(4)
    rows = [(f"c{r.randrange(5)}", r.randrange(6), r.randrange(4)) for _ in range(60)] + [("c1", None, 2)]
    got = C.rank_correlation_bootstrap(spark.createDataFrame(rows, "cluster string, x int, y int"), "cluster", 200, 11).first()
    own = defaultdict(list)
    for c, x, y in rows:
        if x is not None:
            own[c].append((x, y))
    names = sorted(own)
    numbered = spark.createDataFrame([(c, k, len(names)) for k, c in enumerate(names)], "cluster string, _k int, _m int")
    drawn = defaultdict(list)
    for x in B.plan(numbered, [], 200, 11).collect():
        drawn[x.draw] += own[names[x._k]] * x.weight
    v = [x for x in (rho(d) for d in drawn.values()) if x is not None]
    assert (got.rho, got.rows, got.clusters, got.finite_draws) == (pytest.approx(rho([p for c in own.values() for p in c]), abs=1e-8), 60, 5, len(v))
    assert (got.ci_low, got.ci_high) == pytest.approx((np.quantile(v, 0.025), np.quantile(v, 0.975)), abs=1e-6)


def test_effects_cover_all_pairs_of_the_registered_rules():
    assert {n for n in P.EFFECTS if n.startswith("text_")} == {f"text_{v}" for v in P.VIEWS}
    assert all(a != b for a, b in combinations(P.EFFECTS.values(), 2) if a and b)
