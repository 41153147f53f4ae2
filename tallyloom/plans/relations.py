"""Queries of filters, joins, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import guards as G
from tallyloom.operators import relational as R
from tallyloom.operators.order_statistics import nth_values
from tallyloom.plans import observations as O
from tallyloom.plans.registry import Tables, query

_DIGEST = "sha256('{seed}:' || {item})"


@query("FLT1_SRC9_parsed_subsets", "select l_returnflag, count(*) as n, count(*) filter (l_discount > 0.02) as parsed, count(*) filter (l_quantity > 25) as scored, count(*) filter (l_discount > 0.02 and l_quantity > 25) as parsed_and_scored from lineitem group by 1")
def subsets(t: Tables) -> DataFrame:
    parsed, scored = F.col("l_discount") > 0.02, F.col("l_quantity") > 25
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(parsed).alias("parsed"), F.count_if(scored).alias("scored"), F.count_if(parsed & scored).alias("parsed_and_scored"))


@query("FLT3_complete_cases", f"with {O.ARMS_SQL} select doc_id, condition_id, length(hypothesis) as n from arms where doc_id in (select doc_id from arms group by doc_id having count(distinct condition_id) = 7)")
def complete(t: Tables) -> DataFrame:
    return R.complete_cases(O.arms(t.documents), "doc_id", "condition_id", O.ARMS).select("doc_id", "condition_id", F.length("hypothesis").alias("n"))


@query("FLT5_FLT6_well_behaved_ids", f"with {O.ARMS_SQL} select a.doc_id from arms as a join arms as b using (doc_id) where a.condition_id = 'FULL' and b.condition_id = 'B_25' and length(a.hypothesis) <= 1.5 * length(a.reference) and length(b.hypothesis) > 150")
def behaved(t: Tables) -> DataFrame:
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "FULL", "B_25", ["reference", "hypothesis"])
    return p.where((F.length("base_hypothesis") <= 1.5 * F.length("base_reference")) & (F.length("arm_hypothesis") > 150)).select("doc_id")


@query("FLT9_JOI9_JOI10_semi_and_anti", "select 'semi' as side, count(*) as n from customer where c_custkey in (select o_custkey from orders) union all select 'anti', count(*) from customer where c_custkey not in (select o_custkey from orders)")
def semi_anti(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    out = [t.customer.join(keys, "c_custkey", f"left_{side}").agg(F.lit(side).alias("side"), F.count("*").alias("n")) for side in ("semi", "anti")]
    return out[0].unionByName(out[1])


@query("JOI1_INT8_field_agreement", f"with {O.ARMS_SQL} select count(*) as n, count(*) filter (a.hypothesis is not distinct from b.hypothesis) as same_text, count(*) filter (length(a.hypothesis) = length(b.hypothesis)) as same_length from arms as a join arms as b using (doc_id) where a.condition_id = 'A_25' and b.condition_id = 'B_75'")
def agreement(t: Tables) -> DataFrame:
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "A_25", "B_75", ["hypothesis"])
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("base_hypothesis").eqNullSafe(F.col("arm_hypothesis"))).alias("same_text"), F.count_if(F.length("base_hypothesis") == F.length("arm_hypothesis")).alias("same_length"))


@query("JOI2_DID1_paired_arms", f"with {O.ARMS_SQL} select a.doc_id, round((levenshtein(b.reference, b.hypothesis) - levenshtein(a.reference, a.hypothesis)) / length(a.reference), 9) as delta from arms as a join arms as b using (doc_id) where a.condition_id = 'FULL' and b.condition_id = 'B_50'")
def deltas(t: Tables) -> DataFrame:
    p = R.paired(O.arms(t.documents), "doc_id", "condition_id", "FULL", "B_50", ["reference", "hypothesis"])
    d = X.edit_distance(F.col("arm_reference"), F.col("arm_hypothesis")) - X.edit_distance(F.col("base_reference"), F.col("base_hypothesis"))
    return p.select("doc_id", F.round(d / F.length("base_reference"), 9).alias("delta"))


@query("JOI3_SET2_SET3_coverage", "select 'missing' as side, count(*) as n from (select doc_id from documents except select doc_id from labels) union all select 'unexpected', count(*) from (select doc_id from labels except select doc_id from documents)")
def coverage(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.subtract(b).agg(F.lit("missing").alias("side"), F.count("*").alias("n")).unionByName(b.subtract(a).agg(F.lit("unexpected").alias("side"), F.count("*").alias("n")))


@query("JOI4_three_way_join", "select n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def three_way(t: Tables) -> DataFrame:
    at = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return at.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("JOI5_JOI6_WRK5_WIN18_workload", """select row_number() over (order by model, n_nationkey, budget, member) as call_index, model, n_nationkey, budget, member
    from nation, (select unnest(['BASE', 'SPECIALIZED']) as model), (select unnest([64, 100, 150]) as budget), (select unnest(['a', 'b']) as member)""")
def workload(t: Tables) -> DataFrame:
    at = t.nation.select("n_nationkey", F.explode(F.array(F.lit("BASE"), F.lit("SPECIALIZED"))).alias("model"))
    at = at.withColumn("budget", F.explode(F.array(*map(F.lit, (64, 100, 150))))).withColumn("member", F.explode(F.array(F.lit("a"), F.lit("b"))))
    at = G.assert_unique(at, ["model", "n_nationkey", "budget", "member"])
    return R.numbered(at, [F.col(c) for c in ("model", "n_nationkey", "budget", "member")], "call_index").withColumn("call_index", F.col("call_index") + 1)


@query("JOI7_DID7_matched_blank", """select o.o_orderkey, round(o.o_totalprice - b.blank, 4) as gain from orders as o left join (select o_orderpriority, avg(o_totalprice) as blank from orders where o_orderstatus = 'P' group by 1) as b using (o_orderpriority) where o_orderstatus = 'F'""")
def blank(t: Tables) -> DataFrame:
    b = t.orders.where("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("blank"))
    return t.orders.where("o_orderstatus = 'F'").join(b, "o_orderpriority", "left").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("blank"), 4).alias("gain"))


@query("JOI11_JOI16_unanswered_turns", """select c.conv_id, c.turn from conversations as c left join conversations as n on n.conv_id = c.conv_id and n.turn = c.turn + 1 where n.conv_id is null""")
def unanswered(t: Tables) -> DataFrame:
    following = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.conversations.select("conv_id", "turn").join(following, ["conv_id", "turn"], "left_anti")


_SPANS = """(select user_id, event_id, epoch_us(ts) as s, epoch_us(ts) + 1000000 * (1 + event_id % 50) * 60 as e from events)"""


@query("overlapping_events", f"select count(*) as pairs, count(distinct a.event_id) as events from {_SPANS} as a join {_SPANS} as b on a.user_id = b.user_id and a.event_id < b.event_id and b.s < a.e and b.e > a.s")
def overlap(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = t.events.select("user_id", "event_id", at.alias("start"), (at + 1000000 * (1 + F.col("event_id") % 50) * 60).alias("end"))
    other = spans.select("user_id", F.col("event_id").alias("o_event"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    return R.overlaps(spans, other, "user_id").where("event_id < o_event").agg(F.count("*").alias("pairs"), F.count_distinct("event_id").alias("events"))


@query("JOI15_latest_not_after", "select user_id, event_id, (select max(b.event_id) from events as b where b.user_id = a.user_id and b.event_type = 'purchase' and b.event_id <= a.event_id) as latest from events as a")
def latest(t: Tables) -> DataFrame:
    past = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(past).alias("latest"))


@query("JOI17_conflicting_references", "select text, count(distinct source) as sources from documents group by text having count(distinct source) > 1")
def conflicts(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.count_distinct("source").alias("sources")).where("sources > 1")


@query("JOI18_derangement", f"with {O.PAIRS_SQL} select doc_id, round(levenshtein(reference, coalesce(lead(hypothesis) over w, first_value(hypothesis) over w)) / length(reference), 9) as cer from pairs window w as (partition by lang order by doc_id)")
def derangement(t: Tables) -> DataFrame:
    d = R.deranged(O.pairs(t.documents), "doc_id", ["lang"], ["hypothesis"])
    return d.select("doc_id", F.round(X.edit_distance(F.col("reference"), F.col("next_hypothesis")) / F.length("reference"), 9).alias("cer"))


@query("JOI19_nearest_representative", "select n_nationkey, arg_min(o, (d, o)) as nearest from (select n_nationkey, o, pow(n_nationkey % 5 - o % 3 * 2, 2) + pow(n_nationkey // 5 - o // 3 * 3, 2) as d from nation, (select unnest(range(6)) as o)) group by 1")
def nearest(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).alias("y"))
    reps = t.spark.range(6).select(F.col("id").alias("ordinal"), (F.col("id") % 3 * 2).alias("rx"), (F.floor(F.col("id") / 3) * 3).alias("ry"))
    return R.nearest_representative(rows, reps, "x", "y").select("n_nationkey", "nearest")


@query("JOI22_exact_tiles", "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id having count(*) = 4 and count(distinct turn) = 4")
def tiles(t: Tables) -> DataFrame:
    return R.pages_of(t.conversations, "conv_id", "turn", "text", 4)


@query("JOI24_KRN38_common_prefix", f"with {O.PAIRS_SQL} select doc_id, starts_with(reference, substr(hypothesis, 1, 20)) as same_head, list_position(list_transform(range(1, least(length(reference), length(hypothesis)) + 1), lambda i: reference[i] = hypothesis[i]), false) as first_difference from pairs")
def prefix(t: Tables) -> DataFrame:
    same = F.transform(F.arrays_zip(F.split("reference", "").alias("a"), F.split("hypothesis", "").alias("b")), lambda p: p["a"] == p["b"])
    k = F.array_position(F.filter(same, lambda x: x.isNotNull()), F.lit(False))
    return O.pairs(t.documents).select("doc_id", F.startswith("reference", F.substring("hypothesis", 1, 20)).alias("same_head"), F.nullif(k, F.lit(0)).alias("first_difference"))


@query("WIN1_FLT9_stratified_split", f"select doc_id, row_number() over (partition by lang, source order by {_DIGEST.format(seed=7, item='doc_id')}, doc_id) <= ceil(0.3 * count(*) over (partition by lang, source)) as calibration from documents")
def split(t: Tables) -> DataFrame:
    return R.stratified_split(t.documents, "doc_id", ["lang", "source"], 0.3, 7).select("doc_id", "calibration")


@query("WIN2_SMP2_SMP4_first_in_hash_order", f"select doc_id, lang from documents qualify row_number() over (partition by lang order by {_DIGEST.format(seed=9, item='doc_id')}, doc_id) <= 5")
def first(t: Tables) -> DataFrame:
    return R.first_of_each(t.documents, "doc_id", ["lang"], 5, 9).select("doc_id", "lang")


@query("WIN3_half_split", f"select p_partkey, ntile(2) over (partition by p_brand order by {_DIGEST.format(seed=3, item='p_partkey')}, p_partkey) as half from part")
def halves(t: Tables) -> DataFrame:
    from tallyloom.functions.text import digest

    return t.part.select("p_partkey", F.ntile(2).over(Window.partitionBy("p_brand").orderBy(digest(3, F.col("p_partkey")), "p_partkey")).alias("half"))


@query("WIN5_rotation", f"select s_suppkey, position, ['FULL', 'CUT', 'STOP'][position % 3 + 1] as first_arm from (select s_suppkey, row_number() over (order by {_DIGEST.format(seed=5, item='s_suppkey')}, s_suppkey) - 1 as position from supplier)")
def rotation(t: Tables) -> DataFrame:
    return R.rotated(t.supplier.select("s_suppkey"), "s_suppkey", ["FULL", "CUT", "STOP"], 5)


@query("WIN6_shards", "select s_suppkey, (row_number() over (order by s_suppkey) - 1) % 3 as shard from supplier")
def shards(t: Tables) -> DataFrame:
    return R.sharded(t.supplier.select("s_suppkey"), "s_suppkey", 3)


@query("WIN7_argmax_with_ties", "select o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as o_orderkey from orders group by o_custkey")
def argmax(t: Tables) -> DataFrame:
    return R.argmax_rows(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("WIN8_average_rank", "select p_partkey, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2 as rank from part")
def ranks(t: Tables) -> DataFrame:
    return R.average_rank(t.part, "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("WIN9_PVL14_top_share", "select p_partkey from part order by p_retailprice desc, p_partkey limit (select greatest(1, round_even(0.05 * count(*), 0))::bigint from part)")
def top(t: Tables) -> DataFrame:
    return R.top_share(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 0.05).select("p_partkey")


@query("WIN10_lowest_share_threshold", "select p_brand, list_sort(list(p_retailprice))[ceil(0.1 * count(*))::int] as threshold from part group by 1")
def threshold(t: Tables) -> DataFrame:
    return nth_values(t.part, ["p_brand"], "p_retailprice", {"threshold": F.ceil(0.1 * F.col("n")) - 1}).select("p_brand", "threshold")


@query("WIN13_line_spans", "select conv_id, turn, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from conversations")
def spans(t: Tables) -> DataFrame:
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(past), F.lit(0)).alias("start"))


@query("WIN14_boundaries", "select conv_id, turn, lag(role) over w as before, lead(role) over w as after from conversations window w as (partition by conv_id order by turn)")
def boundaries(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("WIN16_strict_majority", "select user_id, case when max(n) * 2 > sum(n) then arg_max(event_type, n) else 'none' end as vote from (select user_id, event_type, count(*) as n from events group by all) group by 1")
def majority(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.when(F.max("n") * 2 > F.sum("n"), F.max_by("event_type", "n")).otherwise("none").alias("vote"))


@query("SMP1_quota_sample", f"select source from (select distinct source from documents) order by {_DIGEST.format(seed=4, item='source')}, source limit 3")
def quota(t: Tables) -> DataFrame:
    from tallyloom.functions.text import digest

    return t.documents.select("source").distinct().orderBy(digest(4, F.col("source")), "source").limit(3)


@query("SMP5_random_survivors", f"select n_nationkey, k from nation, (select unnest(range(16)) as k) qualify row_number() over (partition by n_nationkey order by {_DIGEST.format(seed=8, item='(n_nationkey || ' + chr(39) + ':' + chr(39) + ' || k)')}, k) <= 4")
def survivors(t: Tables) -> DataFrame:
    from tallyloom.functions.text import digest

    at = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    order = Window.partitionBy("n_nationkey").orderBy(digest(8, F.col("n_nationkey"), F.col("k")), "k")
    return at.withColumn("r", F.row_number().over(order)).where("r <= 4").drop("r")


@query("SET1_SET5_SET7_id_sets", f"with {O.ARMS_SQL} select (select count(*) from (select doc_id from arms where condition_id = 'FULL' intersect select doc_id from arms where condition_id = 'B_25')) as shared, (select count(*) from arms) as rows, (select count(distinct doc_id) from arms) as ids")
def id_sets(t: Tables) -> DataFrame:
    a = O.arms(t.documents)
    have = lambda c: F.max(F.col("condition_id") == c)
    each = a.groupBy("doc_id").agg((have("FULL") & have("B_25")).alias("both"), F.count("*").alias("n"))
    return each.agg(F.count_if("both").alias("shared"), F.sum("n").alias("rows"), F.count("*").alias("ids"))


@query("SET6_KRN16_bag_overlap", f"with {O.PAIRS_SQL}, r as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(replace(reference, ' ', ''), '')) as c from pairs) where c <> '' group by all), h as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(replace(hypothesis, ' ', ''), '')) as c from pairs) where c <> '' group by all) select doc_id, sum(least(r.n, h.n))::bigint as common from r join h using (doc_id, c) group by doc_id")
def bag(t: Tables) -> DataFrame:
    p = O.pairs(t.documents)
    side = lambda c: p.select("doc_id", F.explode(F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ""), lambda x: x != "")).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias(c))
    return side("reference").join(side("hypothesis"), ["doc_id", "c"]).groupBy("doc_id").agg(F.sum(F.least("reference", "hypothesis")).alias("common"))


@query("SET8_SET4_straddling_groups", "select text, count(distinct lang) as splits from documents group by text having count(distinct lang) > 1")
def straddle(t: Tables) -> DataFrame:
    return G.straddling(t.documents, "text", "lang")


@query("GEO1_GEO13_tiles", """select n_nationkey, r, c, greatest(0, floor(r * h / 3.0) - 10)::bigint as top, least(h, ceil((r + 1) * h / 3.0) + 10)::bigint as bottom, greatest(0, floor(c * w / 2.0) - 10)::bigint as "left", least(w, ceil((c + 1) * w / 2.0) + 10)::bigint as "right"
    from (select n_nationkey, 100 + 7 * n_nationkey as w, 200 + 11 * n_nationkey as h from nation), (select unnest(range(3)) as r), (select unnest(range(2)) as c)""")
def tile_boxes(t: Tables) -> DataFrame:
    at = t.nation.select("n_nationkey", (100 + 7 * F.col("n_nationkey")).alias("w"), (200 + 11 * F.col("n_nationkey")).alias("h"))
    at = at.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(1))))
    low = lambda k, size, parts: F.greatest(F.lit(0), F.floor(F.col(k) * F.col(size) / parts) - 10)
    high = lambda k, size, parts: F.least(F.col(size).cast("long"), F.ceil((F.col(k) + 1) * F.col(size) / parts) + 10)
    return at.select("n_nationkey", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), low("r", "h", 3).alias("top"), high("r", "h", 3).alias("bottom"), low("c", "w", 2).alias("left"), high("c", "w", 2).alias("right"))


@query("GEO3_pixel_budget", """select n_nationkey, arg_min(k, (abs(floor((100 + k) * (100 + k) * (1 + n_nationkey) / 784.0) - 160 * (1 + n_nationkey % 4)), k)) as step from nation, (select unnest(range(241)) as k) group by 1""")
def budget(t: Tables) -> DataFrame:
    at = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(240))).alias("k"))
    off = F.abs(F.floor((100 + F.col("k")) * (100 + F.col("k")) * (1 + F.col("n_nationkey")) / 784.0) - 160 * (1 + F.col("n_nationkey") % 4))
    return at.groupBy("n_nationkey").agg(F.min_by(F.col("k").cast("long"), F.struct(off, "k")).alias("step"))


@query("GEO8_GEO9_segment_means", "select label, i, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as deviation from (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings) group by all")
def segments(t: Tables) -> DataFrame:
    at = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    return at.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev_samp(F.col("v").cast("double")), 6).alias("deviation"))
