"""Sites by convention against plain loops; mixed logits against integrals by quadrature and planted effects."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import mixed as M
from tallyloom.operators import sites as S
from tallyloom.operators.order_statistics import nth_values
from tallyloom.operators.storage import written

KIND = f"id int, task string, sites array<{S.SITE}>"


def score(logprob, ids=None, lps=None):
    return (logprob, 1 if lps is None else len(lps), ids, lps)


def items(r, n=40):
    out = []
    for i in range(n):
        sites = []
        for k in range(r.randrange(3)):
            shared = [r.randrange(5) for _ in range(r.randrange(3))]
            labels = r.sample(["none", "้", "่", "๊"], r.randrange(2, 5))
            own = lambda shared=shared: [*shared, *(r.randrange(3) for _ in range(r.randrange(0, 3)))] or [1]
            variants = {}
            for label in labels:
                v = {}
                for c in ("image", "no_image"):
                    ids = own()
                    lps = [-r.randrange(1, 9) / 4 for _ in ids]
                    v[c] = score(sum(lps), ids, lps) if r.random() < 0.95 else score(-1.25)
                variants[label] = v
            sites.append((r.choice(["TONE", "UPPER"]), k, labels[0], variants))
        out.append((i, r.choice("ab"), sites))
    return out


def by_hand(site, condition, convention):
    variants = {k: v[condition] for k, v in site[3].items()}
    if convention == "sum":
        return {k: v[0] for k, v in variants.items()}
    if any(v[3] is None for v in variants.values()):
        return None
    if convention == "mean":
        return {k: v[0] / v[1] for k, v in variants.items()}
    for at in range(99):
        heads = {v[2][at] if at < len(v[2]) else None for v in variants.values()}
        if None in heads:
            return None
        if len(heads) > 1:
            return {k: v[3][at] for k, v in variants.items()}


def best(scores):
    return min(scores, key=lambda k: (-round(scores[k], 9), k))


def exploded(spark, rows):
    return spark.createDataFrame(rows, KIND).select("id", "task", F.explode("sites").alias("s")).select("id", "task", "s.*")


def test_conventions(spark):
    rows = items(random.Random(3))
    got = {(r.convention, r.kind): r for r in S.by_convention(exploded(spark, rows)).collect()}
    for convention in S.CONVENTIONS:
        for kind in ("TONE", "UPPER"):
            sites = [s for _, _, own in rows for s in own if s[0] == kind]
            scores = {c: [by_hand(s, c, convention) for s in sites] for c in ("image", "no_image")}
            right = {c: [best(x) == s[2] for x, s in zip(scores[c], sites, strict=True) if x is not None] for c in scores}
            r = got[convention, kind]
            assert (r.sites, r.unscorable) == (len(right["image"]), len(sites) - len(right["image"]))
            assert (r.oracle, r.prior) == (pytest.approx(np.mean(right["image"]), abs=1e-9), pytest.approx(np.mean(right["no_image"]), abs=1e-9))


def test_a_known_site(spark):
    variants = {"none": {"image": score(-3.0), "no_image": score(-0.5)}, "้": {"image": score(-1.0), "no_image": score(-2.0)}}
    rows = [(1, "t", [("TONE", 0, "้", variants)])]
    (r,) = S.outcomes(exploded(spark, rows)).collect()
    assert (r.oracle, r.prior, r.image_gain, r.contrastive_05, r.contrastive_10) == (1, 0, 1.0, 1, 1)
    (s,) = S.by_convention(exploded(spark, rows)).where("convention = 'first_divergent'").collect()
    assert (s.sites, s.unscorable, s.oracle) == (0, 1, None)


def test_summary(spark):
    rows = items(random.Random(9), 120)
    scored = S.outcomes(exploded(spark, rows)).withColumn("page", F.col("id") % 9)
    for r in S.summary(scored, "page", ["oracle", "contrastive_05"], 200, 4).collect():
        sites = [s for _, t, own in rows for s in own if (t, s[0]) == (r.task, r.kind)]
        score_ = lambda s: {k: v["image"][0] - (0.5 * v["no_image"][0] if r.measure != "oracle" else 0) for k, v in s[3].items()}  # noqa: E731, B023
        assert r.sites == len(sites) and r.estimate == pytest.approx(np.mean([best(score_(s)) == s[2] for s in sites]), abs=1e-9)
        gains = [s[3][s[2]]["image"][0] - s[3][s[2]]["no_image"][0] for s in sites]
        assert r.image_gain_median == pytest.approx(np.median(gains)) and r.image_gain_share_positive == pytest.approx(np.mean(np.array(gains) > 0), abs=1e-9)
        assert r.ci_low <= r.estimate <= r.ci_high


def test_greedy_sites(spark):
    ref = "ข้าว ราคา"
    rows = [(ref, "ข้าว ราคา", None), (ref, "ข่าว ราคา", None), (ref, "something else", 0.5), (ref, None, 0.5), (ref, "ข้าว ราค่า", 0.9)]
    df = spark.createDataFrame(rows, "r string, o string, b double").withColumns({"k": F.array(F.lit("TONE"), F.lit("TONE_ABSENT")), "p": F.array(F.lit(1), F.lit(ref.index("ค")))})
    got = [x[0] for x in df.select(S.greedy_right(*(F.col(c) for c in "rokpb"))).collect()]
    assert got == [[1, 1], [0, 1], [0, 0], None, [1, 0]]


def test_laplace_is_near_the_integral():
    """Of one group with one sub-group: two intercepts whose sum is normal with the variances' sum, integrated on a grid."""
    x, n, y = np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([30.0, 20.0]), np.array([18.0, 15.0])
    points = np.array([[0.2, 0.4, 0.6, 0.8], [-0.3, 0.1, 0.3, 0.0], [0.2, 0.4, 0.0, 0.0]])
    got = M.laplace(x, n, y, np.array([0, 0]), points)
    u = np.linspace(-12, 12, 20001)
    for p, value in zip(points, got, strict=True):
        sd = np.hypot(*p[2:])
        eta = (x @ p[:2])[:, None] + sd * u
        f = np.exp((y[:, None] * eta - n[:, None] * np.logaddexp(0, eta)).sum(axis=0) - u**2 / 2) / np.sqrt(2 * np.pi)
        assert value == pytest.approx(np.log(f.sum() * (u[1] - u[0])), abs=0.02)


def planted(spark, beta, sd_group, sd_sub, groups=60, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        b = sd_group * r.normal()
        for s in range(2):
            c = sd_sub * r.normal()
            for k in range(48):
                a, d = k % 2, k // 2 % 2
                eta = beta[0] + beta[1] * a + beta[2] * d + beta[3] * a * d + b + c
                rows.append((g, s, a, d, int(r.random() < 1 / (1 + np.exp(-eta)))))
    return spark.createDataFrame(rows, "g int, s int, a int, d int, ok int")


NAMES = ("one", "a", "d", "a:d")


def terms_of(names=NAMES):
    every = {"one": F.lit(1), "a": F.col("a"), "d": F.col("d"), "a:d": F.col("a") * F.col("d")}
    return {n: every[n] for n in names}


def test_planted_effects_are_recovered(spark):
    beta = [0.3, 0.8, -0.6, 1.0]
    full, null, statistic, df, p = M.likelihood_ratio(planted(spark, beta, 0.9, 0.5), "g", "s", terms_of(), ["a:d"], F.col("ok"))
    assert full.passed and null.passed, (full.checks, null.checks)
    assert np.all(np.abs(full.estimates[:4] - beta) < 3 * full.errors[:4]) and np.all(full.errors[:4] < 0.3)
    assert abs(full.estimates[4] - 0.9) < 3 * full.errors[4] and abs(full.estimates[5] - 0.5) < 3 * full.errors[5]
    assert statistic == pytest.approx(2 * (full.log_likelihood - null.log_likelihood)) and df == 1 and p < 1e-6


def test_faults_of_a_fit_are_reported(spark):
    rows = planted(spark, [0.3, 0.8, -0.6, 1.0], 0.9, 0.5, groups=20)
    separated = rows.withColumn("ok", F.when(F.col("a") == 1, 1).otherwise(F.col("ok")))
    terms = terms_of(NAMES[:3])
    fit = M.fit(written(M.counted(separated, "g", "s", terms, F.col("ok"))), list(terms))
    assert not fit.passed and not fit.checks["no_separation"]
    with pytest.raises(Exception, match="a term or an outcome is null"):
        M.counted(rows.withColumn("ok", F.when(F.col("g") > 0, F.col("ok"))), "g", "s", terms_of(), F.col("ok")).collect()


def test_counting_keeps_the_likelihood(spark):
    """A group's cells give what its single rows give."""
    rows = planted(spark, [0.3, 0.8, -0.6, 1.0], 0.9, 0.5, groups=3)
    points = np.array([[0.1, 0.2, 0.3, -0.2, 0.7, 0.4]])
    got = M.log_likelihoods(M.counted(rows, "g", "s", terms_of(), F.col("ok")), points)
    want = 0.0
    for g in range(3):
        own = rows.where(F.col("g") == g).select("s", *(c.cast("double").alias(f"x{k}") for k, c in enumerate(terms_of().values())), "ok").collect()
        x = np.array([list(r)[1:-1] for r in own])
        want += M.laplace(x, np.ones(len(own)), np.array([float(r.ok) for r in own]), np.array([r.s for r in own]), points)[0]
    assert got[0] == pytest.approx(want, rel=1e-9)


def test_order_statistics_read_their_values_once(spark, tmp_path):
    """Values may come from alignments: no pass makes them again."""
    seen = tmp_path / "seen"

    def made(x: pd.Series) -> pd.Series:
        with seen.open("a") as f:
            f.write("." * len(x))
        return x * 1.0

    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("g"), F.pandas_udf(made, "double")("id").alias("v"))
    got = nth_values(rows, ["g"], "v", {"low": F.lit(3), "high": F.col("n") - 1}).collect()
    assert sorted((r.g, r.n, r.low, r.high) for r in got) == [(0, 10_000, 6.0, 19_998.0), (1, 10_000, 7.0, 19_999.0)]
    assert len(seen.read_text()) == 20_000
