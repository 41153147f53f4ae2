"""Bootstraps of clusters that share the relation of draws (operators/resample.py): documents with labels, clustered by source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import resample as B
from tallyloom.plans.registry import Tables, query

#: Draws of each bootstrap.
DRAWS = 10_000
_LABELLED = "labelled as (select doc_id // 20 % 2 as prompt, source, lang, n_chars, quality, toxic from documents join labels using (doc_id))"


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id")


def _drawn(df: DataFrame, seed: int, sums: Mapping[str, Column], draws: int = DRAWS) -> tuple[DataFrame, DataFrame]:
    """Sums of all clusters in one row, with their number, and of every draw."""
    c = B.cluster_sums(df, "source", [], dict(sums))
    return c.agg(*(F.sum(n).alias(n) for n in sums), F.count("*").alias("clusters")), B.draw_sums(c, B.plan(c, [], draws, seed), [], list(sums))


def _drawn_sql(table: str, seed: int, sums: Mapping[str, str], at: str = "", where: str = "true") -> str:
    """Clusters, plan and draws of a table as common table expressions whose names end in `at`."""
    weighted = ", ".join(f"sum({n} * weight) as {n}" for n in sums)
    return f"""c{at} as (select *, row_number() over (order by source) - 1 as k, count(*) over () as m from (select source, {', '.join(f'{v} as {n}' for n, v in sums.items())} from {table} where {where} group by source)),
    plan{at} as (select draw, k, count(*) as weight from (select draw, ('0x' || substr(sha256('{seed}:' || draw || ':' || s), 1, 8))::bigint % m as k from (select m, draw, unnest(range(m)) as s from (select distinct m from c{at}), (select unnest(range({DRAWS})) as draw))) group by all),
    draws{at} as (select draw, {weighted} from plan{at} join c{at} using (k) group by draw)"""


def hybrid_quantiles(values: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Aggregates: the sorted values at int(alpha * n), and at int((1 - alpha) * n) - 1, alpha being half of what is left out."""
    s, n, alpha = F.array_sort(F.collect_list(values)), F.count(values), (1 - confidence) / 2
    return F.get(s, F.floor(alpha * n).cast("int")), F.get(s, F.least(n - 1, F.floor((1 - alpha) * n) - 1).cast("int"))


_HYBRID = "round(s[greatest(0, floor(0.025 * n))::int + 1], 6) as ci_low, round(s[least(n - 1, floor(0.975 * n) - 1)::int + 1], 6) as ci_high"
_SORTED = "q as (select list_sort(list(v)) as s, count(v) as n from (select {} as v from draws) where v is not null)"
_KEPT = {"num": "sum(n_chars) filter (quality = 1)", "den": "count(*) filter (quality = 1)"}


@query("BOO3_BOO7_finite_cluster_bootstrap", f"""with {_LABELLED}, {_drawn_sql('labelled', 51, {'num': 'coalesce(sum(n_chars) filter (toxic = 1), 0)', 'den': 'count(*) filter (toxic = 1)'})}, v as (select num / nullif(den, 0) as v from draws)
    select (select count(*) from c) as clusters, round((select sum(num) / nullif(sum(den), 0) from c), 6) as estimate, count(v) as finite_draws, round(quantile_cont(v, 0.025), 6) as ci_low, round(quantile_cont(v, 0.975), 6) as ci_high from v""")
def finite(t: Tables) -> DataFrame:
    """Mean length of toxic documents; draws without one have no value and are left out; linear quantiles."""
    toxic = F.col("toxic") == 1
    point, draws = _drawn(labelled(t), 51, {"num": F.when(toxic, F.col("n_chars")).otherwise(0), "den": toxic.cast("long")})
    v = F.try_divide("num", "den")
    ends = draws.agg(F.count(v).alias("finite_draws"), F.round(F.percentile(v, 0.025), 6).alias("ci_low"), F.round(F.percentile(v, 0.975), 6).alias("ci_high"))
    return point.select("clusters", F.round(v, 6).alias("estimate")).join(ends, how="cross")


@query("BOO20_QNT5_mean_of_clusters", f"""with {_LABELLED}, {_drawn_sql('labelled', 52, {'v': 'avg(n_chars)', 'one': '1'})}
    select round((select avg(v) from c), 6) as estimate, round(quantile_cont(v / one, 0.025), 6) as ci_low, round(quantile_cont(v / one, 0.975), 6) as ci_high, (select count(*) from c) as clusters from draws""")
def means(t: Tables) -> DataFrame:
    """Mean of one value a cluster."""
    one = labelled(t).groupBy("source").agg(F.avg("n_chars").alias("x"))
    point, draws = _drawn(one, 52, {"v": F.col("x"), "one": F.lit(1)})
    v = F.col("v") / F.col("one")
    ends = draws.agg(F.round(F.percentile(v, 0.025), 6).alias("ci_low"), F.round(F.percentile(v, 0.975), 6).alias("ci_high"))
    return point.select(F.round(v, 6).alias("estimate"), "clusters").join(ends, how="cross")


@query("BOO4_QNT4_hybrid_interval", f"""with {_LABELLED}, {_drawn_sql('labelled', 53, _KEPT)}, {_SORTED.format('num / den')}
    select (select round(sum(num) / sum(den), 6) from c) as estimate, {_HYBRID}, (select count(*) from c) as clusters from q""")
def hybrid(t: Tables) -> DataFrame:
    good = F.col("quality") == 1
    point, draws = _drawn(labelled(t), 53, {"num": F.when(good, F.col("n_chars")), "den": F.when(good, 1)})
    low, high = hybrid_quantiles(F.try_divide("num", "den"))
    return point.select(F.round(F.col("num") / F.col("den"), 6).alias("estimate"), "clusters").join(draws.agg(F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high")), how="cross")


@query("BOO18_paired_contrast", f"""with {_LABELLED}, {_drawn_sql('labelled', 54, {'v': 'avg(n_chars) filter (prompt = 1) - avg(n_chars) filter (prompt = 0)', 'one': '1'})}, {_SORTED.format('v / one')}
    select (select round(avg(v), 6) from c) as estimate, {_HYBRID}, (select count(*) from c) as clusters from q""")
def contrast(t: Tables) -> DataFrame:
    """Mean over clusters of the difference between two levels, here of blocks of 20 ids; a cluster that lacks one is refused."""
    level = lambda k: F.avg(F.when(F.floor(F.col("doc_id") / 20) % 2 == k, F.col("n_chars")))
    each = labelled(t).groupBy("source").agg((level(1) - level(0)).alias("d"))
    each = each.withColumn("d", F.coalesce("d", F.raise_error(F.concat(F.lit("a level is missing in cluster "), "source")).cast("double")))
    point, draws = _drawn(each, 54, {"v": F.col("d"), "one": F.lit(1)})
    low, high = hybrid_quantiles(F.col("v") / F.col("one"))
    return point.select(F.round(F.col("v") / F.col("one"), 6).alias("estimate"), "clusters").join(draws.agg(F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high")), how="cross")


@query("BOO21_BOO24_paired_gain", f"""with gains as (select b.source, b.lang, (l.toxic = 0)::int - (l.quality = 1)::int as gain from documents as b join labels as l using (doc_id)), {_drawn_sql('gains', 55, {'num': 'sum(gain)', 'den': 'count(*)'})}, {_SORTED.format('num / den')}
    select (select round(sum(num) / sum(den), 6) from c) as estimate, {_HYBRID}, (select count(*) from c) as clusters from q""")
def gain(t: Tables) -> DataFrame:
    """Keyed difference of two outcomes of the same item, then clusters drawn. An item of one side only has no difference."""
    base = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", (F.col("quality") == 1).cast("int").alias("base")), "doc_id")
    gains = base.join(t.labels.select("doc_id", (F.col("toxic") == 0).cast("int").alias("rescue")), "doc_id").withColumn("gain", F.col("rescue") - F.col("base"))
    point, draws = _drawn(gains, 55, {"num": F.col("gain"), "den": F.lit(1)})
    low, high = hybrid_quantiles(F.col("num") / F.col("den"))
    return point.select(F.round(F.col("num") / F.col("den"), 6).alias("estimate"), "clusters").join(draws.agg(F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high")), how="cross")


_SHARE = {"num": "count(*) filter (toxic = 1)", "den": "count(*)"}


@query("BOO12_BOO13_unpaired_contrast", f"""with {_LABELLED}, {_drawn_sql('labelled', 56, _SHARE, 'a', "lang = 'en'")}, {_drawn_sql('labelled', 57, _SHARE, 'b', "lang <> 'en'")},
    draws as (select draw, a.num / a.den - b.num / b.den as v from drawsa as a join drawsb as b using (draw)), q as (select list_sort(list(v)) as s, count(v) as n from draws),
    e as (select (select sum(num) / sum(den) from ca) - (select sum(num) / sum(den) from cb) as e)
    select round(e, 9) as estimate, round(s[floor(0.025 * n)::int + 1], 9) as ci_low, round(s[floor(0.975 * n)::int], 9) as ci_high, s[floor(0.025 * n)::int + 1] > 0 and e >= 0.05 as material from q, e""")
def unpaired(t: Tables) -> DataFrame:
    """Difference of shares between two sets of clusters that are drawn by two plans."""
    sums = {"num": (F.col("toxic") == 1).cast("long"), "den": F.lit(1)}
    (a, da), (b, db) = (_drawn(labelled(t).where(which), seed, sums) for which, seed in (("lang = 'en'", 56), ("lang <> 'en'", 57)))
    share = lambda x: F.col(f"{x}.num") / F.col(f"{x}.den")
    v = da.alias("a").join(db.alias("b"), "draw").select((share("a") - share("b")).alias("v"))
    low, high = B.index_quantiles(F.col("v"))[0], B.upper_less_one(F.col("v"))
    point = a.alias("a").join(b.alias("b"), how="cross").select((share("a") - share("b")).alias("e"))
    out = point.join(v.agg(low.alias("low"), high.alias("high")), how="cross")
    return out.select(F.round("e", 9).alias("estimate"), F.round("low", 9).alias("ci_low"), F.round("high", 9).alias("ci_high"), ((F.col("low") > 0) & (F.col("e") >= 0.05)).alias("material"))


@query("BOO25_pooled_share", f"""with {_LABELLED}, {_drawn_sql('labelled', 58, {'num': 'count(*) filter (quality = 1 and toxic = 1)', 'den': 'count(*) filter (quality = 1)'})}, {_SORTED.format('num / nullif(den, 0)')}, e as (select sum(num) as changed, sum(den) as ended from c)
    select ended::bigint as ended, changed::bigint as changed, round(changed / ended, 9) as share, round(s[floor(0.025 * n)::int + 1], 9) as ci_low, round(s[least(n - 1, floor(0.975 * n))::int + 1], 9) as ci_high, round(s[least(n - 1, floor(0.95 * n))::int + 1], 9) as upper_95 from q, e""")
def pooled(t: Tables) -> DataFrame:
    """Share of some items among others, pooled over languages, an item counting as often as its cluster is drawn."""
    good = F.col("quality") == 1
    point, draws = _drawn(labelled(t), 58, {"num": (good & (F.col("toxic") == 1)).cast("long"), "den": good.cast("long")})
    v = F.try_divide("num", "den")
    (low, high), (_, upper) = B.index_quantiles(v), B.index_quantiles(v, 0.05, 0.95)
    r = lambda x, name: F.round(x, 9).alias(name)
    return point.select(F.col("den").alias("ended"), F.col("num").alias("changed"), r(v, "share")).join(draws.agg(r(low, "ci_low"), r(high, "ci_high"), r(upper, "upper_95")), how="cross")


_INF = "case when den > 0 then num / den when num > 0 then 'Infinity'::double end"


@query("BOO26_QNT6_PVL3_ratio_test", f"""with {_LABELLED}, {_drawn_sql('labelled', 59, {'num': 'count(*) filter (toxic = 1)', 'den': 'count(*) filter (toxic = 1 and n_chars > 6000)'})}, {_SORTED.format(_INF)}
    select (select round({_INF}, 9) from (select sum(num) as num, sum(den) as den from c)) as ratio, round(s[floor(0.025 * n)::int + 1], 9) as ci_low, round(s[least(n - 1, floor(0.975 * n))::int + 1], 9) as ci_high,
    round((1 + len(list_filter(s, lambda x: x <= 2.0))) / (1 + n), 9) as p_one_sided, s[floor(0.025 * n)::int + 1] > 2.0 as passes from q""")
def ratio(t: Tables) -> DataFrame:
    """Ratio of two counts, infinite where the second is 0, missing where both are; its interval and p against 2."""
    toxic = F.col("toxic") == 1
    point, draws = _drawn(labelled(t), 59, {"num": toxic.cast("long"), "den": (toxic & (F.col("n_chars") > 6000)).cast("long")})
    v = F.when(F.col("den") > 0, F.col("num") / F.col("den")).when(F.col("num") > 0, float("inf"))
    low, high = B.index_quantiles(v)
    r = lambda x, name: F.round(x, 9).alias(name)
    ends = draws.agg(r(low, "ci_low"), r(high, "ci_high"), r(B.one_sided_p(v, 2.0), "p_one_sided"), (low > 2.0).alias("passes"))
    return point.select(r(v, "ratio")).join(ends, how="cross")
