"""Queries of aggregations, resampling and inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import relational as R
from tallyloom.operators import resample as B
from tallyloom.operators.order_statistics import nth_values
from tallyloom.plans import observations as O
from tallyloom.plans.registry import Tables, query

_LEV = "levenshtein(reference, hypothesis)"
#: Draws of the registered bootstraps.
DRAWS = 10_000


@query("AGG1_AGG6_group_summary", """select l_returnflag, count(*) as n, count(distinct l_suppkey) as clusters, round(avg((l_quantity > 25)::int), 9) as accuracy, round(sum((l_quantity > 25)::int) filter (l_discount > 0.02) / count(*) filter (l_discount > 0.02), 9) as conditional_accuracy,
    round(avg((l_discount <= 0.02)::int), 9) as failure_rate from lineitem group by 1""")
def group_summary(t: Tables) -> DataFrame:
    right, parsed = F.col("l_quantity") > 25, F.col("l_discount") > 0.02
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("clusters"), F.round(F.avg(right.cast("int")), 9).alias("accuracy"),
        F.round(F.try_divide(F.count_if(right & parsed), F.count_if(parsed)), 9).alias("conditional_accuracy"), F.round(F.avg((~parsed).cast("int")), 9).alias("failure_rate"),
    )


@query("AGG2_AGG3_marginal_summaries", "select l_returnflag, l_linestatus, count(*) as n, count(*) filter (l_quantity > 25) as correct from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def marginals(t: Tables) -> DataFrame:
    return t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("correct"))


@query("AGG4_AGG50_cluster_heterogeneity", """with c as (select l_returnflag, l_suppkey, avg((l_quantity > 25)::int) as a from lineitem group by all)
    select l_returnflag, round(min(a), 9) as lowest, round(quantile_cont(a, 0.25), 9) as q25, round(median(a), 9) as middle, round(quantile_cont(a, 0.75), 9) as q75, round(max(a), 9) as highest, round(coalesce(stddev_samp(a), 0.0), 9) as deviation, count(*) filter (a = 1) as perfect, count(*) filter (a = 0) as zero from c group by 1""")
def heterogeneity(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("a"))
    r = lambda x, n: F.round(x, 9).alias(n)
    return c.groupBy("l_returnflag").agg(
        r(F.min("a"), "lowest"), r(F.percentile("a", 0.25), "q25"), r(F.percentile("a", 0.5), "middle"), r(F.percentile("a", 0.75), "q75"), r(F.max("a"), "highest"),
        r(F.coalesce(F.stddev_samp("a"), F.lit(0.0)), "deviation"), F.count_if(F.col("a") == 1).alias("perfect"), F.count_if(F.col("a") == 0).alias("zero"),
    )


def _medians(df: DataFrame, group: str, value: str, digits: int, **positions: Column) -> DataFrame:
    """group, n, middle (the mean of the two middle values) and values at other positions; exact, and no group is gathered."""
    n = F.col("n")
    at = nth_values(df, [group], value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2), **positions})
    return at.withColumn("middle", F.round((F.col("_a") + F.col("_b")) / 2, digits)).drop("_a", "_b")


@query("AGG5_CMP2_latency", "select event_type, count(value) as n, round(median(value), 6) as middle, min(value) as lowest, max(value) as highest, round(sum(value), 4) as total from events group by 1")
def latency(t: Tables) -> DataFrame:
    ends = t.events.groupBy("event_type").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.round(F.sum("value"), 4).alias("total"))
    return ends.join(_medians(t.events, "event_type", "value", 6), "event_type").select("event_type", "n", "middle", "lowest", "highest", "total")


@query("AGG7_AGG8_AGG9_AGG10_AGG11_KRN1_KRN5_cer_by_condition", f"""with {O.ARMS_SQL}, d as (select *, {_LEV} as d, length(reference) as n from arms)
    select condition_id, count(*) as regions, round(avg(d / n), 9) as macro_cer, round(avg(least(1.0, d / n)), 9) as macro_cer_clamped, round(sum(d) / sum(n), 9) as micro_cer, count(*) filter (d > n) as over_one, count(*) filter (hypothesis = '') as empty from d group by 1""")
def cer(t: Tables) -> DataFrame:
    d = O.arms(t.documents).select("condition_id", "hypothesis", X.edit_distance(F.col("reference"), F.col("hypothesis")).alias("d"), F.length("reference").alias("n"))
    return d.groupBy("condition_id").agg(
        F.count("*").alias("regions"), F.round(F.avg(F.col("d") / F.col("n")), 9).alias("macro_cer"), F.round(F.avg(F.least(F.lit(1.0), F.col("d") / F.col("n"))), 9).alias("macro_cer_clamped"),
        F.round(F.try_divide(F.sum("d"), F.sum("n")), 9).alias("micro_cer"), F.count_if(F.col("d") > F.col("n")).alias("over_one"), F.count_if(F.col("hypothesis") == "").alias("empty"),
    )


@query("AGG13_AGG14_efficiency", "select l_linestatus, round(median(l_extendedprice), 4) as middle, max(l_quantity) as peak, round(avg((l_tax > 0.04)::int), 9) as share, bool_and(l_quantity >= 1) as sound from lineitem group by 1")
def efficiency(t: Tables) -> DataFrame:
    rest = t.lineitem.groupBy("l_linestatus").agg(F.max("l_quantity").alias("peak"), F.round(F.avg((F.col("l_tax") > 0.04).cast("int")), 9).alias("share"), F.bool_and(F.col("l_quantity") >= 1).alias("sound"))
    return rest.join(_medians(t.lineitem, "l_linestatus", "l_extendedprice", 4).drop("n"), "l_linestatus")


@query("AGG22_outcome_shares", "select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from events group by 1")
def shares(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9))


@query("AGG23_AGG24_AGG25_conditional_totals", "select o_orderstatus, count(*) filter (o_totalprice > 150000 and o_orderpriority = '1-URGENT') as both, count(*) filter (o_totalprice > 150000) as dear, round(sum(o_totalprice) filter (o_orderpriority = '1-URGENT'), 2) as urgent from orders group by 1")
def conditional(t: Tables) -> DataFrame:
    dear, urgent = F.col("o_totalprice") > 150000, F.col("o_orderpriority") == "1-URGENT"
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(dear & urgent).alias("both"), F.count_if(dear).alias("dear"), F.round(F.sum(F.when(urgent, F.col("o_totalprice"))), 2).alias("urgent"))


@query("AGG29_transitions", "select before, role as after, count(*) as n from (select role, lag(role) over (partition by conv_id order by turn) as before from conversations) where before is not null group by all")
def transitions(t: Tables) -> DataFrame:
    at = t.conversations.select(F.col("role").alias("after"), F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return at.where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


@query("AGG30_AGG31_geometric_mean", "select l_linestatus, round(exp(avg(ln(l_extendedprice / l_quantity)) filter (l_extendedprice > 0 and l_quantity > 0)), 6) as geomean from lineitem group by 1")
def geomean(t: Tables) -> DataFrame:
    r = F.when((F.col("l_extendedprice") > 0) & (F.col("l_quantity") > 0), F.col("l_extendedprice") / F.col("l_quantity"))
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.exp(F.avg(F.log(r))), 6).alias("geomean"))


@query("AGG32_AGG34_paired_fates", f"with {O.ARMS_SQL} select a.d as base, b.d as arm, count(*) as n from (select doc_id, least({_LEV}, 3) as d from arms where condition_id = 'A_75') as a join (select doc_id, least({_LEV}, 3) as d from arms where condition_id = 'B_25') as b using (doc_id) group by all")
def fates(t: Tables) -> DataFrame:
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "A_75", "B_25", ["reference", "hypothesis"])
    d = lambda s: F.least(X.edit_distance(F.col(f"{s}_reference"), F.col(f"{s}_hypothesis")), F.lit(3)).cast("long")
    return p.groupBy(d("base").alias("base"), d("arm").alias("arm")).agg(F.count("*").alias("n"))


@query("AGG35_AGG42_AGG44_k_reads", """with f as (select user_id, event_type, bool_or(value > 50) as found, sum(value) as w from events group by all), u as (select user_id, count(*) as k, count(distinct found) as states, bool_or(found) as hit, sum(w) as w from f group by 1)
    select count(*) filter (states > 1) as variable, count(*) filter (k = 5) as complete, round(sum(w) filter (hit) / sum(w), 9) as share from u""")
def k_reads(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 50).alias("found"), F.sum("value").alias("w"))
    u = f.groupBy("user_id").agg(F.count("*").alias("k"), F.count_distinct("found").alias("states"), F.bool_or("found").alias("any"), F.sum("w").alias("w"))
    return u.agg(F.count_if(F.col("states") > 1).alias("variable"), F.count_if(F.col("k") == 5).alias("complete"), F.round(F.sum(F.when(F.col("any"), F.col("w"))) / F.sum("w"), 9).alias("share"))


@query("AGG39_outcome_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def pivot(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return out.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("AGG40_AGG41_gain_by_group", """select p_brand, sum(p_size) filter (q > 30 and p_size <= 30)::bigint as lost, sum(p_size) filter (q <= 30 and p_size > 30)::bigint as gained from (select p_brand, p_size, p_retailprice % 60 as q from part) group by 1""")
def gains(t: Tables) -> DataFrame:
    p = t.part.withColumn("q", F.col("p_retailprice") % 60)
    total = lambda c: F.sum(F.when(c, F.col("p_size")))
    return p.groupBy("p_brand").agg(total((F.col("q") > 30) & (F.col("p_size") <= 30)).alias("lost"), total((F.col("q") <= 30) & (F.col("p_size") > 30)).alias("gained"))


@query("AGG43_k_subset_curve", """with f as (select user_id, event_type, bool_or(value > 80) as found from events group by all), types as (select distinct event_type as e from events), one as (select e as s, 1 as k, [e] as m from types),
    two as (select a.e || '+' || b.e as s, 2 as k, [a.e, b.e] as m from types as a, types as b where a.e < b.e), subsets as (from one union all from two), hit as (select s, k, user_id, bool_or(found and list_contains(m, event_type)) as hit from f, subsets group by all), share as (select s, k, avg(hit::int) as v from hit group by all)
    select k, round(avg(v), 9) as share, count(*) as subsets from share group by k""")
def curve(t: Tables) -> DataFrame:
    from itertools import combinations

    f = t.events.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 80).alias("found"))
    types = sorted(r[0] for r in f.select("event_type").distinct().collect())  # arms of the study: a handful
    sets = [(k, list(c)) for k in (1, 2) for c in combinations(types, k)]
    wide = f.groupBy("user_id").agg(F.collect_set(F.when(F.col("found"), F.col("event_type"))).alias("hits"))
    each = [F.avg(F.arrays_overlap("hits", F.array(*map(F.lit, c))).cast("int")).alias(str(i)) for i, (_, c) in enumerate(sets)]
    row = wide.agg(*each)
    long = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{i}`").alias("v")) for i, (k, _) in enumerate(sets)))).alias("x")).select("x.*")
    return long.groupBy("k").agg(F.round(F.avg("v"), 9).alias("share"), F.count("*").alias("subsets"))


@query("AGG51_AGG52_format_audit", r"""select count(*) as n, count(*) filter (regexp_matches(text, '^\s')) as leading_space, count(*) filter (contains(text, chr(10))) as lines, count(*) filter (regexp_matches(text, '[0-9]')) as digits, count(*) filter (length(text) < 80) as short from conversations""")
def formats(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.conversations.agg(F.count("*").alias("n"), F.count_if(c.rlike(r"^\s")).alias("leading_space"), F.count_if(c.contains("\n")).alias("lines"), F.count_if(c.rlike("[0-9]")).alias("digits"), F.count_if(F.length(c) < 80).alias("short"))


@query("AGG53_AGG56_value_distribution", "select lang, least(n_chars // 1000, 9) as thousand, count(*) as n from documents group by all")
def distribution(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).alias("thousand")).agg(F.count("*").alias("n"))


@query("AGG54_AGG55_CMP51_consistency", "select text, count(*) as n, count(distinct (lang, source)) = 1 as same from documents group by text having count(*) > 1")
def consistency(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.count("*").alias("n"), (F.count_distinct(F.struct("lang", "source")) == 1).alias("same")).where("n > 1")


@query("AGG48_cells", "select p_brand, p_type, count(*) as n, round(avg(p_size), 9) as mean from part group by all having count(*) >= 3")
def cells(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 9).alias("mean")).where("n >= 3")


@query("AGG58_AGG59_inventory", "select lang, count(*) as n, count(distinct source) as sources, count(*) >= 100 as adequate from documents group by 1")
def inventory(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), (F.count("*") >= 100).alias("adequate"))


@query("AGG62_off_diagonal_products", "select p_brand, round((pow(sum(p_size), 2) - sum(p_size * p_size)) / (count(*) * (count(*) - 1)), 6) as within from part group by 1 having count(*) > 1")
def products(t: Tables) -> DataFrame:
    s = F.sum("p_size").cast("double")
    n = F.count("*")
    return t.part.groupBy("p_brand").agg(F.round((s * s - F.sum(F.col("p_size") * F.col("p_size"))) / (n * (n - 1)), 6).alias("within"), n.alias("n")).where("n > 1").drop("n")


@query("AGG67_control_quantiles", "select event_type, round(median(value), 6) as middle, list_sort(list(value))[(0.1 * count(value))::int + 1] as q10, list_sort(list(value))[floor(0.9 * count(value))::int + 1] as q90 from events group by 1")
def control(t: Tables) -> DataFrame:
    return _medians(t.events, "event_type", "value", 6, q10=F.round(0.1 * F.col("n")), q90=F.floor(0.9 * F.col("n"))).drop("n")


@query("KRN18_KRN19_similarity_and_drift", f"with {O.PAIRS_SQL} select doc_id, round(1 - {_LEV} / greatest(length(reference), length(hypothesis), 1), 9) as similarity, round({_LEV} / greatest(1, length(reference)), 9) as drift from pairs")
def similarity(t: Tables) -> DataFrame:
    return O.pairs(t.documents).select("doc_id", F.round(X.similarity(F.col("reference"), F.col("hypothesis")), 9).alias("similarity"), F.round(X.drift(F.col("reference"), F.col("hypothesis")), 9).alias("drift"))


def _boot_sql(cluster: str, strata: str | None, source: str, num: str, den: str, seed: int) -> str:
    s = f"{strata}, " if strata else ""
    part = f"partition by {strata}" if strata else ""
    key = f" || ':' || {strata}" if strata else ""
    using = f"({s}k)"
    return f"""c as (select *, row_number() over ({part} order by {cluster}) - 1 as k, count(*) over ({part}) as m from (select {s}{cluster}, sum({num}) as num, sum({den}) as den from {source} group by all)),
    slots as (select {s}m, draw, unnest(range(m)) as s from (select distinct {s}m from c), (select unnest(range({DRAWS})) as draw)),
    plan as (select draw, {s}k, count(*) as weight from (select draw, {s}('0x' || substr(sha256('{seed}:' || draw{key} || ':' || s), 1, 8))::bigint % m as k from slots) group by all),
    draws as (select draw, sum(num * weight) / nullif(sum(den * weight), 0) as v from plan join c using {using} group by draw),
    q as (select list_sort(list(v)) as s, count(v) as n from draws where v is not null)"""


@query("BOO1_BOO2_BOO5_QNT1_stratified_cluster_bootstrap", f"""with {O.PAIRS_SQL}, {_boot_sql('source', 'lang', 'pairs', _LEV, 'length(reference)', 17)}
    select round((select sum(num) / sum(den) from c), 9) as estimate, (select count(*) from c) as clusters, round(s[floor(0.025 * n)::int + 1], 9) as ci_low, round(s[least(n - 1, floor(0.975 * n))::int + 1], 9) as ci_high from q""")
def bootstrap(t: Tables) -> DataFrame:
    out = B.ratio_interval(O.pairs(t.documents), "source", ["lang"], X.edit_distance(F.col("reference"), F.col("hypothesis")), F.length("reference"), DRAWS, 17)
    return out.select(F.round("estimate", 9).alias("estimate"), "clusters", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


def _paired_draws(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Clusters and draws of the mean difference between two arms under one plan."""
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "FULL", "B_25", ["source", "reference", "hypothesis"])
    d = (X.edit_distance(F.col("arm_reference"), F.col("arm_hypothesis")) - X.edit_distance(F.col("base_reference"), F.col("base_hypothesis"))) / F.length("base_reference")
    c = B.cluster_sums(p.withColumn("source", F.col("base_source")), "source", [], {"num": d, "den": F.lit(1)})
    return c, B.draw_sums(c, B.plan(c, [], DRAWS, 23), [], ["num", "den"]).withColumn("v", F.try_divide("num", "den"))


_PAIRED = f"""with {O.ARMS_SQL}, w as (select a.source, ({_LEV.replace('reference', 'b.reference').replace('hypothesis', 'b.hypothesis')} - {_LEV.replace('reference', 'a.reference').replace('hypothesis', 'a.hypothesis')}) / length(a.reference) as d from arms as a join arms as b using (doc_id) where a.condition_id = 'FULL' and b.condition_id = 'B_25'),
    {_boot_sql('source', None, 'w', 'd', '1', 23)}, e as (select sum(num) / sum(den) as e from c)"""


@query("BOO6_BOO8_BOO11_BOO17_PVL1_PVL2_PVL3_QNT2_QNT3_paired_bootstrap", _PAIRED + """ select round((select e from e), 9) as estimate, round((select quantile_cont(v, 0.025) from draws), 9) as linear_low, round(s[floor(0.975 * n)::int], 9) as upper_less_one,
    round((select count(*) filter (abs(v - e) >= abs(e)) / count(*) from draws, e), 9) as p_plain, round((select (1 + count(*) filter (abs(v - e) >= abs(e))) / (1 + count(*)) from draws, e), 9) as p_plus_one, round((select (1 + count(*) filter (v <= 0.05)) / (1 + count(*)) from draws), 9) as p_one_sided from q""")
def paired_bootstrap(t: Tables) -> DataFrame:
    c, draws = _paired_draws(t)
    point = c.agg((F.sum("num") / F.sum("den")).alias("e"))
    each = draws.join(F.broadcast(point), how="cross")
    v, e = F.col("v"), F.max("e")
    far = F.count_if(F.abs(v - F.col("e")) >= F.abs(F.col("e")))
    n = F.count("v")
    r = lambda x, name: F.round(x, 9).alias(name)
    return each.agg(r(e, "estimate"), r(F.percentile("v", 0.025), "linear_low"), r(B.upper_less_one(v), "upper_less_one"), r(far / n, "p_plain"), r((1 + far) / (1 + n), "p_plus_one"), r(B.one_sided_p(v, 0.05), "p_one_sided"))


@query("WIN11_PVL4_PVL5_PVL6_holm", """with p as (select n_nationkey, n_regionkey, case when n_nationkey % 7 <> 0 then (n_nationkey * 37 % 100) / 1000.0 end as p from nation), r as (select *, least(1.0, (count(p) over (partition by n_regionkey, p is null) - row_number() over (partition by n_regionkey, p is null order by p, n_nationkey) + 1) * p) as raw from p)
    select n_nationkey, case when p is not null then round(max(raw) over (partition by n_regionkey, p is null order by p, n_nationkey rows unbounded preceding), 9) end as p_holm, p is not null and coalesce(max(raw) over (partition by n_regionkey, p is null order by p, n_nationkey rows unbounded preceding) < 0.05, false) as reject from r""")
def holm(t: Tables) -> DataFrame:
    p = t.nation.select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 7 != 0, (F.col("n_nationkey") * 37 % 100) / 1000.0).alias("p"))
    return B.holm(p, "p", ["n_regionkey"]).select("n_nationkey", F.round("p_holm", 9).alias("p_holm"), "reject")


@query("PVL11_PVL12_PVL13_auroc", """with s as (select lang, n_chars, toxic = 1 as y from documents join labels using (doc_id)), r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2 as r from s)
    select lang, round((sum(r) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / nullif(count(*) filter (y) * count(*) filter (not y), 0), 9) as auroc, count(*) filter (y) as positives, count(*) filter (not y) as negatives from r group by lang""")
def auroc(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("y")), "doc_id")
    return B.auroc(s, "n_chars", "y", ["lang"]).withColumn("auroc", F.round("auroc", 9))


@query("DID1_difference_in_differences", f"""with {O.ARMS_SQL}, e as (select condition_id, doc_id, {_LEV} / length(reference) as cer from arms), p as (select doc_id, max(cer) filter (condition_id = 'FULL') as f, max(cer) filter (condition_id = 'A_50') as a, max(cer) filter (condition_id = 'B_50') as b from e group by 1)
    select count(*) as n, round(avg(a - f), 9) as delta_a, round(avg(b - f), 9) as delta_b, round(avg((b - f) - (a - f)), 9) as did from p where f is not null and a is not null and b is not null""")
def did(t: Tables) -> DataFrame:
    arms = ["FULL", "A_50", "B_50"]
    e = O.arms(t.documents).where(F.col("condition_id").isin(arms)).withColumn("cer", X.edit_distance(F.col("reference"), F.col("hypothesis")) / F.length("reference"))
    p = e.groupBy("doc_id").pivot("condition_id", arms).agg(F.max("cer")).dropna()
    a, b = F.col("A_50") - F.col("FULL"), F.col("B_50") - F.col("FULL")
    return p.agg(F.count("*").alias("n"), F.round(F.avg(a), 9).alias("delta_a"), F.round(F.avg(b), 9).alias("delta_b"), F.round(F.avg(b - a), 9).alias("did"))


@query("DEC4_rules", """select o_orderkey, case when o_totalprice < 20000 then 'format_loss' when o_totalprice > 300000 then 'loop' when o_orderstatus = 'P' then 'omission' when o_orderpriority = '1-URGENT' then 'overgeneration' else 'misread' end as cause,
    case when o_totalprice / 500000 - 0.1 >= 0.2 then 'ADEQUATE_HEADROOM' when o_totalprice / 500000 - 0.1 >= 0.1 then 'MARGINAL_HEADROOM' else 'FLOOR_LIMITED' end as headroom from orders""")
def rules(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    cause = F.when(p < 20000, "format_loss").when(p > 300000, "loop").when(F.col("o_orderstatus") == "P", "omission").when(F.col("o_orderpriority") == "1-URGENT", "overgeneration").otherwise("misread")
    room = F.when(p / 500000 - 0.1 >= 0.2, "ADEQUATE_HEADROOM").when(p / 500000 - 0.1 >= 0.1, "MARGINAL_HEADROOM").otherwise("FLOOR_LIMITED")
    return t.orders.select("o_orderkey", cause.alias("cause"), room.alias("headroom"))


@query("CNT1_CNT3_contrastive_choice", """select p_partkey, arg_max(v, (2 * a - b, -v)) as choice, round(max(2 * a - b), 9) as best from (select p_partkey, unnest(range(3)) as v, ln(1 + p_size + unnest(range(3))) as a, ln(1 + p_size * (1 + unnest(range(3)))) as b from part) group by 1""")
def contrastive(t: Tables) -> DataFrame:
    at = t.part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"))
    score = 2 * F.log(1 + F.col("p_size") + F.col("v")) - F.log(1 + F.col("p_size") * (1 + F.col("v")))
    return at.groupBy("p_partkey").agg(F.max_by(F.col("v").cast("long"), F.struct(score, -F.col("v"))).alias("choice"), F.round(F.max(score), 9).alias("best"))


@query("INT5_DEC20_named_checks", "select 'customers have nations' as name, count(*) filter (c_nationkey not between 0 and 24) = 0 as ok from customer union all select 'orders have customers', count(*) = 0 from orders where o_custkey not in (select c_custkey from customer) union all select 'texts are not empty', count(*) filter (text = '') = 0 from documents")
def checks(t: Tables) -> DataFrame:
    one = t.customer.agg(F.lit("customers have nations").alias("name"), (F.count_if(~F.col("c_nationkey").between(0, 24)) == 0).alias("ok"))
    lost = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("orders have customers").alias("name"), (F.count("*") == 0).alias("ok"))
    return one.unionByName(lost).unionByName(t.documents.agg(F.lit("texts are not empty").alias("name"), (F.count_if(F.col("text") == "") == 0).alias("ok")))


def binomial_upper(k: int, n: int, level: float = 0.95) -> float | None:
    """One-sided exact upper bound of a share k / n, by halving the interval in which the tail crosses the level."""
    if n == 0 or k >= n:
        return None if n == 0 else 1.0
    low, high = k / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(k + 1)]
    for _ in range(80):
        p = (low + high) / 2
        tail = sum(math.exp(c + j * math.log(p) + (n - j) * math.log1p(-p)) for j, c in enumerate(logs)) if p < 1 else 0.0
        low, high = (p, high) if tail > 1 - level else (low, p)
    return (low + high) / 2
