"""Queries of sites whose variants were scored with and without an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import text as X
from tallyloom.operators import sites as S
from tallyloom.operators.order_statistics import nth_values
from tallyloom.operators.storage import written
from tallyloom.plans.contrasts import sized_plan_sql
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.rereads import pages
from tallyloom.plans.resampling import DRAWS

KINDS = ("TONE", "UPPER", "LOWER", "TONE_ABSENT")
MEASURES = ("oracle", "prior", "contrastive_05", "contrastive_10")
#: Token log probabilities in hundredths, by item and site x, token k, variant j and condition c, in both languages.
_LP = "-((({x} * 31 + {k} * 7 + {j} * 13 + {c} * 17) * 7919) % 500)"
_SITE_SQL = f"""s as (select doc_id, lang as task, source, i, (doc_id % 1000003) * 3 + i as x from documents, (select unnest(range(3)) as i) where i <= doc_id % 3),
    v as (select *, j, c, ['TONE', 'UPPER', 'LOWER', 'TONE_ABSENT'][(x % 4 + 1)::int] as kind, chr((97 + x % 3)::int) as reference, chr((97 + j)::int) as label, case when x % 11 = 0 and j = 0 then 1 else 3 end as tokens from s, (select unnest(range(3)) as j), (select unnest(range(2)) as c)),
    t as (select *, [x % 5, x % 7 + case when x % 2 = 0 then j else 0 end, 10 + j] as ids, [{', '.join(_LP.format(x='x', k=k, j='j', c='c') + ' / 100' for k in range(3))}] as lps from v),
    f as (select doc_id, i, c, min(pos) filter (d > 1 or m < 3) as p, min(pos) filter (m < 3) as ended from (select doc_id, i, c, pos, count(distinct ids[pos]) as d, count(*) as m from t, unnest(range(1, 4)) as u(pos) where pos <= tokens group by all) group by all),
    w as (select t.*, list_sum(lps[1:tokens]) as total, list_sum(lps[1:tokens]) / tokens as mean, case when f.p is not null and (f.ended is null or f.p < f.ended) then lps[f.p] end as first from t join f using (doc_id, i, c))"""


def site_rows(t: Tables) -> DataFrame:
    """doc_id, task, source, i and a site: kind, reference and nested scores of three variants; every eleventh has a variant that is a prefix of the others."""
    x, lit = F.col("x"), F.lit
    base = t.documents.select("doc_id", F.col("lang").alias("task"), "source", F.explode(F.sequence(lit(0).cast("long"), F.col("doc_id") % 3)).alias("i")).withColumn("x", (F.col("doc_id") % 1000003) * 3 + F.col("i"))

    def scored(j: int, c: int):
        ids = F.array((x % 5).cast("int"), (x % 7 + F.when(x % 2 == 0, j).otherwise(0)).cast("int"), lit(10 + j))
        lps = F.array(*(F.expr(_LP.format(x="x", k=k, j=j, c=c)) / 100 for k in range(3)))
        n = F.when((x % 11 == 0) & lit(j == 0), 1).otherwise(3)
        ids, lps = F.slice(ids, 1, n), F.slice(lps, 1, n)
        return F.struct(F.aggregate(lps, lit(0.0), lambda s, v: s + v).alias("logprob"), n.alias("tokens"), ids.alias("token_ids"), lps.alias("token_logprobs"))

    variants = F.create_map(*(y for j in range(3) for y in (lit("abc"[j]), F.create_map(lit("image"), scored(j, 0), lit("no_image"), scored(j, 1)))))
    kind, right = F.element_at(F.array(*map(lit, KINDS)), (x % 4 + 1).cast("int")), F.element_at(F.array(*map(lit, "abc")), (x % 3 + 1).cast("int"))
    return base.select("doc_id", "task", "source", "i", kind.alias("kind"), right.alias("reference"), variants.alias("variants"))


_BEST = "arg_min(label, (-round({0}, 6), label)) filter (c = {1})"


@query("AGG21_CNT2_sites_by_convention", f"""with {_SITE_SQL}, b as (select doc_id, i, kind, any_value(reference) as reference, {', '.join(f"{_BEST.format(e, c)} as {n}{c}" for n, e in (('total', 'total'), ('mean', 'mean'), ('first', 'first')) for c in (0, 1))}, count(first) filter (c = 0) = 3 as divided, count(first) filter (c = 1) = 3 as divided1 from w group by all),
    l as (select kind, 'sum' as convention, (total0 = reference)::int as o, (total1 = reference)::int as p from b union all select kind, 'mean', (mean0 = reference)::int, (mean1 = reference)::int from b union all select kind, 'first_divergent', case when divided then (first0 = reference)::int end, case when divided1 then (first1 = reference)::int end from b)
    select convention, kind, count(o) as sites, count(*) filter (o is null) as unscorable, round(avg(o), 9) as oracle, round(avg(p), 9) as prior from l group by all""")
def by_convention(t: Tables) -> DataFrame:
    return S.by_convention(rounded(site_rows(t)))


def rounded(sites: DataFrame) -> DataFrame:
    """Sums and means of log probabilities at six decimals, so that additions in another order can't part equal scores."""
    return sites.withColumn("variants", F.transform_values("variants", lambda k, v: F.transform_values(v, lambda c, s: s.withField("logprob", F.round(s["logprob"], 6)))))


@query("AGG20_CMP3_CNT1_CNT3_site_summary", f"""with {_SITE_SQL}, y as (select doc_id, i, task, kind, source, reference, label, max(round(total, 6)) filter (c = 0) as a, max(round(total, 6)) filter (c = 1) as b from w group by all),
    o as (select doc_id, i, task, kind, source, (arg_min(label, (-a, label)) = any_value(reference))::int as oracle, (arg_min(label, (-b, label)) = any_value(reference))::int as prior, (arg_min(label, (-round(a - 0.5 * b, 6), label)) = any_value(reference))::int as "contrastive_05", (arg_min(label, (-round(a - b, 6), label)) = any_value(reference))::int as "contrastive_10", round(max(a - b) filter (label = reference), 6) as gain from y group by all),
    g as (select task, kind, source, count(*) as n, {', '.join(f'sum("{m}") as "{m}"' for m in MEASURES)} from o group by all), n as (select *, row_number() over (partition by task, kind order by source) - 1 as k, count(*) over (partition by task, kind) as m from g), {sized_plan_sql(99, 'n')},
    d as (select task, kind, draw, {', '.join(f'round(sum("{m}" * weight) / sum(n * weight), 9) as "{m}"' for m in MEASURES)} from plan join n using (m, k) group by all), l as (unpivot d on {', '.join(f'"{m}"' for m in MEASURES)} into name measure value v), q as (select task, kind, measure, list_sort(list(v)) as s, count(*) as n from l group by all),
    e as (select task, kind, {', '.join(f'round(sum("{m}") / sum(n), 9) as "{m}"' for m in MEASURES)} from g group by all), p as (unpivot e on {', '.join(f'"{m}"' for m in MEASURES)} into name measure value estimate), z as (select task, kind, count(*) as sites, round(median(gain), 9) as image_gain_median, round(avg((gain > 0)::int), 9) as image_gain_share_positive from o group by all)
    select task, kind, measure, sites, estimate, s[floor(0.025 * n)::int + 1] as ci_low, s[least(n - 1, floor(0.975 * n))::int + 1] as ci_high, image_gain_median, image_gain_share_positive from p join q using (task, kind, measure) join z using (task, kind)""")
def site_summary(t: Tables) -> DataFrame:
    """What is right of each kind of mark with the image, without it and by their contrast, task by task; sources are drawn."""
    scored = S.outcomes(rounded(site_rows(t))).withColumn("image_gain", F.round("image_gain", 6))
    return S.summary(scored, "source", MEASURES, DRAWS, 99)


@query("CMP3_AGG20_greedy_sites")
def greedy_sites(t: Tables) -> DataFrame:
    """Sites of pages that the output has right, task by task, if it is below the task's chance threshold: the 5th percentile of the rates
    at which outputs fit the next page."""
    r = written(pages(t.conversations).select("conv_id", (F.col("conv_id") % 2).alias("task"), "reference", "output"))  # four plans read it
    by = Window.partitionBy("task").orderBy("conv_id")
    ids = r.select("task", "conv_id").withColumns({"next": F.lead("conv_id").over(by), "first": F.first("conv_id").over(by)}).select("task", "conv_id", F.coalesce("next", "first").alias("other"))
    pairs = ids.where("conv_id <> other").join(r.where("reference <> ''").select("conv_id", "reference"), "conv_id").join(r.select(F.col("conv_id").alias("other"), "output"), "other")
    pairs = pairs.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")  # a distance costs the square of a page's length
    edits = G.each_udf(lambda a, b: {"edits": K.best_window(a, b)[0]}, "edits: long")("reference", "output")["edits"]
    chance = nth_values(pairs.select("task", (edits / F.length("reference")).alias("rate")), ["task"], "rate", {"located_below": F.floor(0.05 * F.col("n"))}).select("task", "located_below")
    at = r.join(F.broadcast(chance), "task", "left").withColumn("sites", X.mark_sites(F.col("reference")))  # one row a task
    right = S.greedy_right(F.col("reference"), F.col("output"), F.col("sites.kind"), F.col("sites.index"), F.col("located_below"))
    each = at.select("task", "located_below", F.explode(F.arrays_zip(F.col("sites.kind").alias("kind"), right.alias("right"))).alias("s"))
    return each.groupBy("task", F.col("s.kind").alias("kind")).agg(F.count("*").alias("sites"), F.sum("s.right").alias("correct"), F.round(F.avg("s.right"), 9).alias("greedy"), F.round(F.max("located_below"), 9).alias("located_below"))
