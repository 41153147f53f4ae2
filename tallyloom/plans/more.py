"""Further queries: workloads, geometry, populations, nested scores, draws of ranks, and text rules that need a parser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import markup as M
from tallyloom.functions import text as X
from tallyloom.operators import relational as R
from tallyloom.operators import resample as B
from tallyloom.plans import observations as O
from tallyloom.plans.registry import Tables, query

_LEV = "levenshtein(reference, hypothesis)"


@query("FLT2_FLT11_FLT12_control_and_failures", "select event_type, count(*) filter (event_id % 10 <> 0) as timed, count(*) filter (value is null or value < 1) as failed, round(avg(value) filter (event_id % 10 <> 0 and value >= 1), 6) as mean from events group by 1")
def failures(t: Tables) -> DataFrame:
    timed, failed = F.col("event_id") % 10 != 0, F.col("value").isNull() | (F.col("value") < 1)
    return t.events.groupBy("event_type").agg(F.count_if(timed).alias("timed"), F.count_if(failed).alias("failed"), F.round(F.avg(F.when(timed & (F.col("value") >= 1), F.col("value"))), 6).alias("mean"))


@query("FLT4_AGG37_readable_in_both", f"with {O.ARMS_SQL} select count(*) as n, count(*) filter (a.hypothesis = b.hypothesis and a.hypothesis <> a.reference) as agree_against_reference from arms as a join arms as b using (doc_id) where a.condition_id = 'A_50' and b.condition_id = 'B_75' and {_LEV.replace('reference', 'a.reference').replace('hypothesis', 'a.hypothesis')} <= 4 and {_LEV.replace('reference', 'b.reference').replace('hypothesis', 'b.hypothesis')} <= 4")
def readable(t: Tables) -> DataFrame:
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "A_50", "B_75", ["reference", "hypothesis"])
    p = p.where((X.edit_distance(F.col("base_reference"), F.col("base_hypothesis")) <= 4) & (X.edit_distance(F.col("arm_reference"), F.col("arm_hypothesis")) <= 4))
    return p.agg(F.count("*").alias("n"), F.count_if((F.col("base_hypothesis") == F.col("arm_hypothesis")) & (F.col("base_hypothesis") != F.col("base_reference"))).alias("agree_against_reference"))


@query("FLT7_FLT8_eligible_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as lines, count(*) filter (length(line) >= 8) as eligible from l group by doc_id")
def lines(t: Tables) -> DataFrame:
    at = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return at.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length("line") >= 8).alias("eligible"))


@query("FLT13_AGG49_signal", "select l_returnflag, avg((l_quantity > 25)::int) - 0.5 >= 0.005 and min(l_quantity) > 0 as present, round(abs(avg((l_quantity > 25)::int) - 0.5), 9) as above_chance from lineitem group by 1")
def signal(t: Tables) -> DataFrame:
    a = F.avg((F.col("l_quantity") > 25).cast("int"))
    return t.lineitem.groupBy("l_returnflag").agg(((a - 0.5 >= 0.005) & (F.min("l_quantity") > 0)).alias("present"), F.round(F.abs(a - 0.5), 9).alias("above_chance"))


@query("JOI8_CMP18_prior_alignment", """with pref as (select o_custkey, case when count(*) filter (o_orderstatus = 'F') > count(*) filter (o_orderstatus = 'O') then 'F' when count(*) filter (o_orderstatus = 'F') < count(*) filter (o_orderstatus = 'O') then 'O' else 'TIE' end as p from orders group by 1)
    select p, count(*) as n, count(*) filter (o_orderstatus = p) as aligned from orders join pref using (o_custkey) where o_orderpriority = '1-URGENT' group by 1""")
def alignment(t: Tables) -> DataFrame:
    f, o = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    pref = t.orders.groupBy("o_custkey").agg(F.when(f > o, "F").when(f < o, "O").otherwise("TIE").alias("p"))
    return t.orders.where("o_orderpriority = '1-URGENT'").join(pref, "o_custkey").groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == F.col("p")).alias("aligned"))


@query("JOI20_CMP47_best_read", f"with {O.ARMS_SQL} select doc_id, round(min({_LEV} / length(reference)), 9) as oracle, arg_min(condition_id, ({_LEV}, condition_id)) as best from arms where condition_id <> 'FULL' group by 1")
def best(t: Tables) -> DataFrame:
    d = X.edit_distance(F.col("reference"), F.col("hypothesis"))
    return O.arms(t.documents).where("condition_id <> 'FULL'").groupBy("doc_id").agg(F.round(F.min(d / F.length("reference")), 9).alias("oracle"), F.min_by("condition_id", F.struct(d.alias("d"), "condition_id")).alias("best"))


@query("JOI21_GEO11_matched_partners", f"with {O.ARMS_SQL}, p as (select doc_id, right(condition_id, 2) as level, count(*) filter (condition_id like 'A%') as a, count(*) filter (condition_id like 'B%') as b from arms where condition_id <> 'FULL' group by all) select level, count(*) filter (a = 1 and b = 1) as matched, count(*) filter (a <> 1 or b <> 1) as unmatched from p group by 1")
def matched(t: Tables) -> DataFrame:
    c = F.col("condition_id")
    p = O.arms(t.documents).where(c != "FULL").groupBy("doc_id", F.right(c, F.lit(2)).alias("level")).agg(F.count_if(c.startswith("A")).alias("a"), F.count_if(c.startswith("B")).alias("b"))
    ok = (F.col("a") == 1) & (F.col("b") == 1)
    return p.groupBy("level").agg(F.count_if(ok).alias("matched"), F.count_if(~ok).alias("unmatched"))


@query("JOI23_JOI25_CMP42_identity_rate", f"with {O.ARMS_SQL} select condition_id, count(*) as n, round(avg((hypothesis = reference)::int), 9) as identical from arms group by 1")
def identity(t: Tables) -> DataFrame:
    return O.arms(t.documents).groupBy("condition_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("hypothesis") == F.col("reference")).cast("int")), 9).alias("identical"))


@query("WIN4_SMP3_first_per_group", "select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 2")
def firsts(t: Tables) -> DataFrame:
    return t.documents.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("r")).where("r <= 2").drop("r")


@query("WIN15_segment_survivor", "select label, arg_max(vec_id, (embedding[1]::double, -vec_id)) as survivor from embeddings group by 1")
def survivor(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.max_by("vec_id", F.struct(F.col("embedding")[0].cast("double").alias("s"), (-F.col("vec_id")).alias("t"))).alias("survivor"))


@query("SMP6_even_grid", "select n_nationkey, i, j from (select n_nationkey, 4 + n_nationkey % 5 as r, 6 + n_nationkey % 3 as c from nation), (select unnest(range(2)) as a), (select unnest(range(3)) as b), lateral (select (2 * a + 1) * r // 4 as i, (2 * b + 1) * c // 6 as j)")
def grid(t: Tables) -> DataFrame:
    at = t.nation.select("n_nationkey", (4 + F.col("n_nationkey") % 5).alias("r"), (6 + F.col("n_nationkey") % 3).alias("c"))
    at = at.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("b", F.explode(F.array(*map(F.lit, range(3)))))
    return at.select("n_nationkey", F.floor((2 * F.col("a") + 1) * F.col("r") / 4).alias("i"), F.floor((2 * F.col("b") + 1) * F.col("c") / 6).alias("j"))


@query("SMP7_SMP9_live_sample", "select doc_id from (select doc_id, n_chars > 5000 as changed, row_number() over (partition by n_chars > 5000 order by sha256('2:' || doc_id), doc_id) as r from documents) where changed or r <= 10")
def live(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", (F.col("n_chars") > 5000).alias("changed"))
    return R.hash_rank(d, "doc_id", ["changed"], 2).where("changed or rank <= 10").select("doc_id")


@query("AGG26_CMP30_escapes", "select conv_id, sum(len(regexp_extract_all(text, '[.!?]')))::bigint as escapes, count(*) filter (length(text) > 200) as caps from conversations group by 1")
def escapes(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.sum(F.regexp_count("text", F.lit("[.!?]"))).alias("escapes"), F.count_if(F.length("text") > 200).alias("caps"))


@query("AGG38_mismatch_classes", "select case when o_totalprice < 50000 then 'near_tie' when o_totalprice > 250000 then 'large_margin' else 'length_only' end as class, count(*) as n, round(avg((o_orderstatus = 'F')::int), 9) as rate from orders group by 1")
def mismatches(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_totalprice") < 50000, "near_tie").when(F.col("o_totalprice") > 250000, "large_margin").otherwise("length_only")
    return t.orders.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 9).alias("rate"))


@query("AGG45_AGG46_AGG47_cells_and_identical", "select lang, n_chars // 5000 as size, count(*) as n, count(*) filter (text = replace(text, 'zz', '')) as identical from documents group by all")
def identical(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", F.floor(F.col("n_chars") / 5000).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.replace("text", F.lit("zz"), F.lit(""))).alias("identical"))


@query("AGG63_AGG65_AGG66_DID5_panel", """with c as (select p_brand, p_size % 2 as model, p_size % 3 as budget, avg(p_retailprice) as m from part group by all), w as (select p_brand, max(m) filter (model = 1 and budget = 0) - max(m) filter (model = 1 and budget = 2) - max(m) filter (model = 0 and budget = 0) + max(m) filter (model = 0 and budget = 2) as did from c group by 1)
    select count(did) as brands, round(avg(did), 6) as did from w""")
def panel(t: Tables) -> DataFrame:
    c = t.part.groupBy("p_brand", (F.col("p_size") % 2).alias("model"), (F.col("p_size") % 3).alias("budget")).agg(F.avg("p_retailprice").alias("m"))
    at = lambda m, b: F.max(F.when((F.col("model") == m) & (F.col("budget") == b), F.col("m")))
    w = c.groupBy("p_brand").agg((at(1, 0) - at(1, 2) - at(0, 0) + at(0, 2)).alias("did"))
    return w.agg(F.count("did").alias("brands"), F.round(F.avg("did"), 6).alias("did"))


@query("BOO15_BOO16_auroc_bootstrap")
def auroc_draws(t: Tables) -> DataFrame:
    """Interval of an AUROC whose clusters are drawn: ranks are made anew in each draw from weighted counts of equal scores."""
    s = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("y")), "doc_id")
    clusters = B.cluster_sums(s, "source", [], {"n": F.lit(1)})
    picked = B.plan(clusters, [], 50, 31).join(clusters.select("_k", "source"), "_k")
    at = s.join(picked, "source").groupBy("draw", "n_chars").agg(F.sum(F.when(F.col("y"), F.col("weight")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("y"), F.col("weight")).otherwise(0)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("draw").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("w", F.col("p") * (below + F.col("q") / 2)).groupBy("draw").agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("v"))
    low, high = B.index_quantiles(F.col("v"))
    return won.agg(F.count("v").alias("draws"), low.alias("ci_low"), high.alias("ci_high"))


@query("WIN8_spearman_by_language", """with r as (select lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2 as a, rank() over (partition by lang order by length(source), doc_id % 17) + (count(*) over (partition by lang, length(source), doc_id % 17) - 1) / 2 as b from documents)
    select lang, round(corr(a, b), 9) as rho from r group by lang""")
def spearman(t: Tables) -> DataFrame:
    d = t.documents.select("lang", "n_chars", F.struct(F.length("source").alias("x"), (F.col("doc_id") % 17).alias("y")).alias("z"))
    a = R.average_rank(d, "n_chars", ["lang"]).withColumnRenamed("rank", "a")
    return R.average_rank(a, "z", ["lang"]).groupBy("lang").agg(F.round(F.corr("a", "rank"), 9).alias("rho"))


@query("BOO26_ratio_with_infinity", "select p_brand, case when sum(p_size % 2) filter (p_size < 5) = 0 then 'Infinity'::double else round(sum(p_size % 3) / sum(p_size % 2) filter (p_size < 5), 9) end as ratio from part group by 1")
def infinite(t: Tables) -> DataFrame:
    den = F.sum(F.when(F.col("p_size") < 5, F.col("p_size") % 2))
    return t.part.groupBy("p_brand").agg(F.when(den == 0, float("inf")).otherwise(F.round(F.try_divide(F.sum(F.col("p_size") % 3), den), 9)).alias("ratio"))


@query("WRK1_WRK2_WRK4_observation_plan", """select n_nationkey, member, ('0x' || substr(sha256('1:' || n_nationkey || ':' || member), 1, 2))::bigint % 2 = 0 as straight from nation, (select unnest(['a', 'b', 'blank']) as member)""")
def observation_plan(t: Tables) -> DataFrame:
    at = t.nation.select("n_nationkey", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("blank"))).alias("member"))
    return at.withColumn("straight", X.digest_number(X.digest(1, F.col("n_nationkey"), F.col("member")), 2) % 2 == 0)


@query("WRK3_condition_grid", "select n_nationkey, family, ratio from nation, (select unnest(['RR', 'PRUNE_GRID', 'RANDOM']) as family), (select unnest([75, 50, 25]) as ratio) union all select n_nationkey, 'FULL', 100 from nation")
def conditions(t: Tables) -> DataFrame:
    cells = [F.struct(F.lit(f).alias("family"), F.lit(r).alias("ratio")) for f in ("RR", "PRUNE_GRID", "RANDOM") for r in (75, 50, 25)] + [F.struct(F.lit("FULL").alias("family"), F.lit(100).alias("ratio"))]
    return t.nation.select("n_nationkey", F.explode(F.array(*cells)).alias("c")).select("n_nationkey", "c.*")


@query("shared_products_of_nations", "select least(c_nationkey, s_nationkey) as a, greatest(c_nationkey, s_nationkey) as b, count(*) as n from customer join supplier on c_custkey % 50 = s_suppkey % 50 group by all having count(*) > 1")
def pairs_twice(t: Tables) -> DataFrame:
    side = lambda d, key, nation: d.groupBy((F.col(key) % 50).alias("k"), F.col(nation).alias(nation)).agg(F.count("*").alias(f"_{nation}"))
    at = side(t.customer, "c_custkey", "c_nationkey").join(side(t.supplier, "s_suppkey", "s_nationkey"), "k")
    return at.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.sum(F.col("_c_nationkey") * F.col("_s_nationkey")).alias("n")).where("n > 1")


@query("GEO2_GEO5_GEO6_GEO12_geometry", """select n_nationkey, round(least(1.0, sqrt(1000000.0 / (w * h))), 9) as scale, w // 28 * 28 as crop_w, ceil(h / 28.0)::bigint * 28 as crop_h, greatest(0, least(w - 56, 14 + n_nationkey % 9)) as shifted, (w // 28) * (h // 28) as patches
    from (select n_nationkey, 900 + 37 * n_nationkey as w, 700 + 53 * n_nationkey as h from nation)""")
def geometry(t: Tables) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    at = t.nation.select("n_nationkey", (900 + 37 * F.col("n_nationkey")).alias("w"), (700 + 53 * F.col("n_nationkey")).alias("h"))
    return at.select(
        "n_nationkey", F.round(F.least(F.lit(1.0), F.sqrt(1000000.0 / (w * h))), 9).alias("scale"), (F.floor(w / 28) * 28).alias("crop_w"), (F.ceil(h / 28) * 28).alias("crop_h"),
        F.greatest(F.lit(0), F.least(w - 56, 14 + F.col("n_nationkey") % 9)).alias("shifted"), (F.floor(w / 28) * F.floor(h / 28)).alias("patches"),
    )


@query("GEO4_GEO7_CMP34_budget_collisions", "with b as (select n_nationkey, r, floor((20 + n_nationkey) * r / 100.0)::bigint as tokens from nation, (select unnest([75, 50, 25, 24]) as r)) select n_nationkey, tokens, count(*) as ratios from b group by all having count(*) > 1")
def collisions(t: Tables) -> DataFrame:
    b = t.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, (75, 50, 25, 24)))).alias("r"))
    return b.groupBy("n_nationkey", F.floor((20 + F.col("n_nationkey")) * F.col("r") / 100.0).alias("tokens")).agg(F.count("*").alias("ratios")).where("ratios > 1")


@query("GEO10_sequence_mask", "select vec_id, list_sum(list_transform(range(16), lambda i: (i % 3 = vec_id % 3)::int))::bigint as kept from embeddings")
def mask(t: Tables) -> DataFrame:
    keep = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i % 3 == F.col("vec_id") % 3).cast("int"))
    return t.embeddings.select("vec_id", F.aggregate(keep, F.lit(0), lambda s, x: s + x).cast("long").alias("kept"))


@query("TXT3_TXT5_TXT26_extract")
def extracted(t: Tables) -> DataFrame:
    e = t.pages.select("page_id", M.extract_udf()(F.col("html")).alias("e"))
    return e.select("page_id", "e.text", "e.figures", "e.unclosed")


@query("TXT7_unwrap_json")
def unwrapped(t: Tables) -> DataFrame:
    raw = F.to_json(F.struct(F.col("text").alias("natural_text")))
    cut = F.when(F.col("turn") % 2 == 0, F.substr(raw, F.lit(1), F.length(raw) - 5)).otherwise(raw)
    return t.conversations.select("conv_id", "turn", M.unwrap_udf()(cut).alias("text"))


@query("TXT15_normal_form")
def forms(t: Tables) -> DataFrame:
    return t.documents.groupBy(M.normal_form_udf()("text").alias("form")).agg(F.count("*").alias("n"))


@query("TXT27_windows")
def phrase_windows(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.explode(M.windows_udf(40)("text")).alias("w"))
    return w.select("doc_id", "w.start", "w.end")


@query("TXT41_TXT42_seed_and_parity", "select s_suppkey, ('0x' || substr(sha256('3:' || s_suppkey), 1, 8))::bigint as seed, ('0x' || substr(sha256('3:' || s_suppkey), 1, 2))::bigint % 2 as parity from supplier")
def seeds(t: Tables) -> DataFrame:
    h = X.digest(3, F.col("s_suppkey"))
    return t.supplier.select("s_suppkey", X.digest_number(h).alias("seed"), (X.digest_number(h, 2) % 2).alias("parity"))


@query("TXT46_CMP46_span_edits")
def edits(t: Tables) -> DataFrame:
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit("<A>").alias("put")), F.struct(F.lit(7).alias("start"), F.lit(12).alias("end"), F.lit("<B>").alias("put")), F.struct(F.lit(12).alias("start"), F.lit(12).alias("end"), F.lit("<C>").alias("put")))
    return t.documents.select("doc_id", M.apply_edits(F.col("text"), spans).alias("text"))


@query("CMP12_CMP13_weighted_shares", "select lang, round(sum(n_chars) filter (doc_id % 4 = 0) / sum(n_chars), 9) as share, sum(n_chars)::bigint as characters from documents group by 1")
def weighted(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.round(F.sum(F.when(F.col("doc_id") % 4 == 0, F.col("n_chars"))) / F.sum("n_chars"), 9).alias("share"), F.sum("n_chars").alias("characters"))


@query("CMP22_DEC7_prior_corrected", "select o_orderkey, case when o_totalprice - 150000 > 0 then 'a' else 'b' end as raw, case when o_totalprice - avg(o_totalprice) over (partition by o_orderpriority) > 0 then 'a' else 'b' end as corrected from orders")
def corrected(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p - 150000 > 0, "a").otherwise("b").alias("raw"), F.when(p - F.avg(p).over(Window.partitionBy("o_orderpriority")) > 0, "a").otherwise("b").alias("corrected"))


@query("CMP45_CMP52_pivot_and_concatenate", "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'user') as user_text, string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'assistant') as assistant_text from conversations group by 1")
def reads(t: Tables) -> DataFrame:
    side = lambda r: F.nullif(X.ordered_text(F.col("turn"), F.when(F.col("role") == r, F.col("text")), "\n\n"), F.lit(""))
    return t.conversations.groupBy("conv_id").agg(side("user").alias("user_text"), side("assistant").alias("assistant_text"))


@query("CMP49_score_definitions", """with s as (select doc_id, toxic = 1 as y, n_chars, length(source) as sl from documents join labels using (doc_id)), l as (select 'n_chars' as name, y, n_chars::double as v from s union all select 'source', y, sl from s), r as (select *, rank() over (partition by name order by v) + (count(*) over (partition by name, v) - 1) / 2 as r from l)
    select name, round((sum(r) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)), 9) as auroc from r group by name""")
def definitions(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", "n_chars", F.length("source").alias("sl")).join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("y")), "doc_id")
    long = s.select("y", F.explode(F.array(F.struct(F.lit("n_chars").alias("name"), F.col("n_chars").cast("double").alias("v")), F.struct(F.lit("source").alias("name"), F.col("sl").cast("double").alias("v")))).alias("x")).select("y", "x.*")
    return B.auroc(long, "v", "y", ["name"]).select("name", F.round("auroc", 9).alias("auroc"))
