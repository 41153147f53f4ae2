"""Resampling as a relation: a plan of draws joined to sums of clusters, one aggregation per statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import digest, digest_number


def cluster_sums(df: DataFrame, cluster: str, strata: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums of each cluster, numbered in each stratum by cluster. Rows are reduced to clusters before any draw."""
    out = df.groupBy(*strata, cluster).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    by = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    return out.withColumn("_k", F.row_number().over(by.orderBy(cluster)) - 1).withColumn("_m", F.count("*").over(by))


def plan(clusters: DataFrame, strata: Sequence[str], draws: int, seed: int | str) -> DataFrame:
    """draw, strata, _k, weight: how often each draw picks each cluster of a stratum, as many picks as clusters.

    A pick is fixed by seed, draw, stratum and place, so any engine makes the same plan and reruns agree. One plan serves all
    statistics over the same clusters, which keeps their covariance.
    """
    sizes = clusters.select(*strata, "_m").distinct()
    slots = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long") - 1)))
    pick = digest_number(digest(seed, F.col("draw"), *(F.col(c) for c in strata), F.col("_s"))) % F.col("_m")
    return slots.withColumn("_k", pick).groupBy("draw", *strata, "_k").agg(F.count("*").alias("weight"))


def draw_sums(clusters: DataFrame, picked: DataFrame, strata: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Weighted sums of every draw, over all its strata."""
    at = picked.join(clusters, [*strata, "_k"])
    return at.groupBy("draw").agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in sums))


def index_quantiles(values: Column, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Aggregates: the values at int(low * n) and min(n - 1, int(high * n)) of the sorted values that are not null."""
    s = F.array_sort(F.collect_list(values))
    n = F.count(values)
    at = lambda q: F.get(s, F.least(n - 1, F.floor(F.lit(q) * n)).cast("int"))
    return at(low), at(high)


def upper_less_one(values: Column, high: float = 0.975) -> Column:
    """Aggregate: the value at int(high * n) - 1 of the sorted values."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor(F.lit(high) * F.count(values)).cast("int") - 1)


def ratio_interval(df: DataFrame, cluster: str, strata: Sequence[str], num: Column, den: Column, draws: int, seed: int | str) -> DataFrame:
    """One row: estimate, ci_low, ci_high, clusters of sum(num) / sum(den) under a stratified cluster bootstrap. Draws without denominator are skipped."""
    c = cluster_sums(df, cluster, strata, {"num": num, "den": den})
    each = draw_sums(c, plan(c, strata, draws, seed), strata, ["num", "den"]).withColumn("v", F.try_divide("num", "den"))
    low, high = index_quantiles(F.col("v"))
    point = c.agg(F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"), F.count("*").alias("clusters"))
    return point.join(each.agg(low.alias("ci_low"), high.alias("ci_high")), how="cross")


def centred_p(values: Column, estimate: Column, plus_one: bool) -> Column:
    """Aggregate: share of draws that lie as far from the estimate as it does from 0."""
    far = F.count_if(F.abs(values - estimate) >= F.abs(estimate))
    n = F.count(values)
    return (1 + far) / (1 + n) if plus_one else far / n


def one_sided_p(values: Column, null: float, greater: bool = True) -> Column:
    """Aggregate: (1 + draws on the null's side) / (1 + draws)."""
    side = values <= null if greater else values >= null
    return (1 + F.count_if(side)) / (1 + F.count(values))


def holm(df: DataFrame, p: str, family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_holm, the step-down adjusted p (a running maximum over ascending p), and reject; null p stay null."""
    by = Window.partitionBy(*family, F.col(p).isNull())
    order = by.orderBy(p)
    m = F.count(p).over(by)
    raw = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    out = df.withColumn("_raw", raw)
    adjusted = F.when(F.col(p).isNotNull(), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("p_holm", adjusted).withColumn("reject", F.coalesce(F.col("p_holm") < alpha, F.lit(False))).drop("_raw")


def auroc(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half: rank sums, no pairs. Null where a side is missing."""
    from tallyloom.operators.relational import average_rank

    ranked = average_rank(df, score, groups)
    pos, neg = F.count_if(F.col(positive)), F.count_if(~F.col(positive))
    total = F.sum(F.when(F.col(positive), F.col("rank")))
    value = F.try_divide(total - pos * (pos + 1) / 2, pos * neg)
    return ranked.groupBy(*groups).agg(value.alias("auroc"), pos.alias("positives"), neg.alias("negatives"))
