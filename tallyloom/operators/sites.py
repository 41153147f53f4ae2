"""Forced readings of sites: nested scores of variants under two conditions, by several conventions, summarised by task and kind of mark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import rereads as V
from tallyloom.operators import contrasts as C
from tallyloom.operators.order_statistics import nth_values
from tallyloom.operators.storage import written

CONVENTIONS = ("sum", "mean", "first_divergent")
#: What a site must hold: its kind, place and right label, and for each label what was scored with and without the image.
SITE = "struct<kind:string,index:int,reference:string,variants:map<string,map<string,struct<logprob:double,tokens:int,token_ids:array<int>,token_logprobs:array<double>>>>>"


def _entries(variants: Column, condition: str) -> Column:
    """(label, score struct) of each variant under a condition."""
    return F.transform(F.map_entries(variants), lambda e: F.struct(e["key"].alias("label"), F.element_at(e["value"], condition).alias("v")))


def shared_prefix(variants: Column, condition: str) -> Column:
    """How many tokens all variants begin with: the depth at which their trie first branches. Null where one of them ends there, as it
    is then a prefix of all others, or where tokens are not recorded."""
    ids = F.transform(_entries(variants, condition), lambda e: e["v"]["token_ids"])
    least = F.array_min(F.transform(ids, F.size))
    apart = F.filter(F.sequence(F.lit(0), least - 1), lambda k: F.size(F.array_distinct(F.transform(ids, lambda s: F.get(s, k)))) > 1)
    return F.when((least > 0) & ~F.exists(ids, lambda s: s.isNull()), F.get(apart, 0))


def variant_scores(variants: Column, condition: str, convention: str) -> Column:
    """array<struct<label, score>> of a site's variants, or null where the convention needs tokens that are not recorded or never part.

    sum: log probability of all tokens; mean: by token; first_divergent: of the first token behind the prefix that all variants share,
    which is what a greedy reader decides by before later tokens hang on different text.
    """
    entries = _entries(variants, condition)
    recorded = ~F.exists(entries, lambda e: e["v"]["token_logprobs"].isNull())
    if convention == "sum":
        return F.transform(entries, lambda e: F.struct(e["label"].alias("label"), e["v"]["logprob"].alias("score")))
    if convention == "mean":
        return F.when(recorded, F.transform(entries, lambda e: F.struct(e["label"].alias("label"), (e["v"]["logprob"] / e["v"]["tokens"]).alias("score"))))
    if convention != "first_divergent":
        raise ValueError(f"unknown convention {convention!r}")
    at = shared_prefix(variants, condition)
    return F.when(recorded & at.isNotNull(), F.transform(entries, lambda e: F.struct(e["label"].alias("label"), F.get(e["v"]["token_logprobs"], at).alias("score"))))


def best_label(scores: Column) -> Column:
    """The label of the greatest score; of equal ones the smallest label. Scores count to nine decimals, as sums of several terms do."""
    return F.array_min(F.transform(scores, lambda s: F.struct(F.round(-s["score"], 9).alias("s"), s["label"].alias("label"))))["label"]


def by_convention(sites: DataFrame, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """convention, keys, sites (scorable with the image), unscorable, oracle and prior: shares of sites whose best variant with, and
    without, the image is the right one. sites: keys, reference, variants. Sites are rows; no site meets another before the sums."""
    rows = sites.withColumn("convention", F.explode(F.array(*map(F.lit, CONVENTIONS))))

    def right(condition: str) -> Column:
        scores = F.coalesce(*(F.when(F.col("convention") == c, variant_scores(F.col("variants"), condition, c)) for c in CONVENTIONS))
        return F.when(scores.isNotNull(), (best_label(scores) == F.col("reference")).cast("int"))

    rows = rows.withColumns({"_o": right("image"), "_p": right("no_image")})
    return rows.groupBy("convention", *keys).agg(F.count("_o").alias("sites"), F.count_if(F.col("_o").isNull()).alias("unscorable"), F.round(F.avg("_o"), 9).alias("oracle"), F.round(F.avg("_p"), 9).alias("prior"))


def outcomes(sites: DataFrame, lambdas: Sequence[float] = (0.5, 1.0)) -> DataFrame:
    """sites with oracle, prior, image_gain and contrastive_<tenths>: right by the best of image - weight * no_image; scores are sums."""
    image, plain = (variant_scores(F.col("variants"), c, "sum") for c in ("image", "no_image"))
    own = lambda c: F.element_at(F.element_at(F.col("variants"), F.col("reference")), c)["logprob"]
    right = lambda scores: (best_label(scores) == F.col("reference")).cast("int")
    mixed = lambda w: F.transform(_entries(F.col("variants"), "image"), lambda e: F.struct(e["label"].alias("label"), (e["v"]["logprob"] - w * F.element_at(F.element_at(F.col("variants"), e["label"]), "no_image")["logprob"]).alias("score")))
    out = {"oracle": right(image), "prior": right(plain), "image_gain": own("image") - own("no_image")}
    return sites.withColumns(out | {f"contrastive_{round(10 * w):02}": right(mixed(w)) for w in lambdas})


def summary(scored: DataFrame, cluster: str, measures: Sequence[str], draws: int, seed: int, keys: Sequence[str] = ("task", "kind")) -> DataFrame:
    """keys, measure, sites, estimate, ci_low, ci_high, and with each the exact median of image_gain and the share above 0.

    Sites are summed by cluster first; clusters are drawn within a task. Results of tasks are never pooled.
    """
    scored = written(scored.select(*keys, cluster, *measures, "image_gain"))
    sums = scored.groupBy(*keys, cluster).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in measures))
    point, v = C.group_draws(sums, cluster, {m: (m, "n") for m in measures}, draws, seed, keys)
    low, high = F.array_sort(F.collect_list("v")), F.count("v")
    ends = v.groupBy(*keys, "statistic").agg(F.get(low, F.floor(F.lit(0.025) * high).cast("int")).alias("ci_low"), F.get(low, F.least(high - 1, F.floor(F.lit(0.975) * high)).cast("int")).alias("ci_high"))
    n = F.col("n")
    middle = nth_values(scored, keys, "image_gain", {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)}).select(*keys, F.round((F.col("_a") + F.col("_b")) / 2, 9).alias("image_gain_median"))
    more = scored.groupBy(*keys).agg(F.count("*").alias("sites"), F.round(F.avg((F.col("image_gain") > 0).cast("int")), 9).alias("image_gain_share_positive")).join(middle, list(keys))
    return point.join(ends, [*keys, "statistic"]).join(more, list(keys)).select(*keys, F.col("statistic").alias("measure"), "sites", "estimate", "ci_low", "ci_high", "image_gain_median", "image_gain_share_positive")


def greedy_right(reference: Column, output: Column, kinds: Column, places: Column, located_below: Column) -> Column:
    """array<int>: of each site whether the output's anchored reading has it right. An output whose rate is not below located_below
    (null: no bound) has read none. The reference is as it is, as places point into it."""

    def run(refs: pd.Series, outs: pd.Series, kinds_: pd.Series, at: pd.Series, bound: pd.Series) -> pd.Series:
        found = []
        for ref, out, ks, ps, most in zip(refs, outs, kinds_, at, bound, strict=True):
            if ref is None or out is None or ks is None:
                found.append(None)
                continue
            hyp = G.extract(out)[0]
            pairs = K.align_anchored(ref, hyp)[0]
            if most is not None and not np.isnan(most) and K.distance(pairs, ref, hyp) / max(1, len(ref)) >= most:
                found.append([0] * len(ks))
                continue
            read = G.Read(pairs, ref, hyp)
            found.append([int(V.site_correct(k, int(p), read, hyp)) for k, p in zip(ks, ps, strict=True)])
        return pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<int>")(reference, output, kinds, places, located_below)
