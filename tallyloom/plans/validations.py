"""Rows derived anew under other rules, frozen lists held against splits, seeds by label, and contrasts of two sets of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import text as X
from tallyloom.operators import contrasts as C
from tallyloom.operators import guards
from tallyloom.operators import resample as B
from tallyloom.plans.audits import words
from tallyloom.plans.reading import records
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.rereads import LATIN, THAI
from tallyloom.plans.resampling import DRAWS

# Contrasts of two sets of pages that are drawn apart ----------------------------------------------------------------------------------

#: Least difference of misread shares that counts.
MISREAD = 0.01
_FRESH = "(doc_id % 1000003) * 6301 % 1000 < 500"
#: Columns of a page's lines, in both languages.
_COLUMNS = (f"{_FRESH} as fresh", "case when (doc_id % 1000003) * 1237 % 1000 < 500 then 'S24' else 'S44' end as size", "1 + n_chars % 7 as marks", f"case when (doc_id % 1000003) * 3571 % 1000 < (case when {_FRESH} then 90 else 40 end) then 1 else 0 end as wrong")


def unpaired_shares(pages: DataFrame, keys: list[str], num: str, den: str, draws: int, seeds: tuple[int, int]) -> DataFrame:
    """keys, estimate, ci_low, ci_high, fresh_pages, old_pages: share of num in den over pages with `fresh` less that over the others, each
    drawn by a plan of its own, as they are not the same pages."""
    sides = []
    for fresh, seed in zip((True, False), seeds, strict=True):
        point, v = C.group_draws(pages.where(F.col("fresh") == fresh).drop("fresh"), "source", {"share": (num, den)}, draws, seed, keys)
        name = "fresh" if fresh else "old"
        sides.append((point.select(*keys, F.col("estimate").alias(f"{name}_share"), F.col("pairs").alias(f"{name}_pages")), v.select(*keys, "draw", F.col("v").alias(name))))
    (p, v), (q, w) = sides
    gap = v.join(w, [*keys, "draw"]).select(*keys, F.round(F.col("fresh") - F.col("old"), C.DIGITS).alias("v"))
    low, high = B.index_quantiles(F.col("v"))[0], B.upper_less_one(F.col("v"))
    ends = gap.groupBy(*keys).agg(low.alias("ci_low"), high.alias("ci_high"))
    return p.join(q, keys).join(ends, keys).withColumn("estimate", F.round(F.col("fresh_share") - F.col("old_share"), C.DIGITS))


def _side_sql(name: str, seed: int, fresh: str) -> str:
    return f"""{name}n as (select level, source, sum(wrong * marks) as x, sum(marks) as m_, row_number() over (partition by level order by source) - 1 as k, count(*) over (partition by level) as m from l where {fresh} group by level, source),
    {name}p as (select m, draw, k, count(*) as weight from (select m, draw, ('0x' || substr(sha256('{seed}:' || draw || ':' || s), 1, 8))::bigint % m as k from (select m, draw, unnest(range(m)) as s from (select distinct m from {name}n), (select unnest(range({DRAWS})) as draw))) group by all),
    {name}d as (select level, draw, round(sum(x * weight) / sum(m_ * weight), 9) as v from {name}p join {name}n using (m, k) group by all), {name}e as (select level, round(sum(x) / sum(m_), 9) as share, count(*) as pages from {name}n group by level)"""


@query("CMP11_BOO12_misread_by_size", f"""with r as (select source, {', '.join(_COLUMNS)} from documents), l as (select *, 'overall' as level from r union all select *, size from r), {_side_sql('a', 121, 'fresh')}, {_side_sql('b', 122, 'not fresh')},
    q as (select level, list_sort(list(round(ad.v - bd.v, 9))) as s, count(*) as n from ad join bd using (level, draw) group by level), z as (select level, ae.share as fresh_share, ae.pages as fresh_pages, be.share as old_share, be.pages as old_pages, s[floor(0.025 * n)::int + 1] as ci_low, s[floor(0.975 * n)::int] as ci_high, round(ae.share - be.share, 9) as estimate from ae join be using (level) join q using (level))
    select *, case when not ((ci_low > 0 or ci_high < 0) and abs(estimate) >= {MISREAD}) then 'no_difference_shown' when estimate > 0 then 'meaningful_text_more_misreads' else 'meaningful_text_fewer_misreads' end as reading from z""")
def misreads(t: Tables) -> DataFrame:
    """Share of misread marks in two sets of pages, over all and by size of letters, and what their difference says."""
    rows = t.documents.selectExpr("source", *_COLUMNS)
    pages = rows.withColumn("level", F.explode(F.array(F.lit("overall"), "size"))).groupBy("level", "source", "fresh").agg(F.sum(F.col("wrong") * F.col("marks")).alias("x"), F.sum("marks").alias("marks"))
    out = unpaired_shares(pages, ["level"], "x", "marks", DRAWS, (121, 122))
    material = ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & (F.abs("estimate") >= MISREAD)
    return out.withColumn("reading", F.when(~material, "no_difference_shown").when(F.col("estimate") > 0, "meaningful_text_more_misreads").otherwise("meaningful_text_fewer_misreads"))


# Rows derived anew ------------------------------------------------------------------------------------------------------------------


def amended(raw: Column, target: Column, opposite: Column) -> tuple[Column, Column]:
    """Category of an output as it was registered, and under the rule that an output with U+FFFD has broken its contract, whatever else it is."""
    registered = X.classify_output(X.newlines(raw), target, opposite)
    return registered, F.when(raw.contains("�"), "OUTPUT_CONTRACT_FAILURE").otherwise(registered)


@query("INT9_amended_categories", f"""with w as (select distinct unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{THAI}'), '[^ \\t-\\r]+')) as a from conversations),
    r as (select a, 'ก' || substr(a, 2) as b, case length(a) % 4 when 0 then a when 1 then 'ก' || substr(a, 2) when 2 then chr(65533) || substr(a, 2) else a || ' ' || a end as raw from w),
    c as (select *, case when raw = a then 'EXACT_TARGET' when raw = b then 'OPPOSITE_MEMBER' when raw = '' then 'EMPTY' when regexp_matches(raw, '\\s') then 'WHITESPACE' when regexp_matches(raw, '[\\x{{0E00}}-\\x{{0E7F}}]') then 'OTHER_THAI' else 'NON_THAI' end as registered from r)
    select registered, case when contains(raw, chr(65533)) then 'OUTPUT_CONTRACT_FAILURE' else registered end as amended, count(*) as rows, sum(length(raw))::bigint as codepoints from c group by all""")
def amendment(t: Tables) -> DataFrame:
    """Categories of outputs of each word under the registered and the amended rule; only outputs with U+FFFD may change."""
    a = F.col("a")
    other, n = F.concat(F.lit("ก"), F.substr(a, F.lit(2))), F.length("a") % 4
    raw = F.when(n == 0, a).when(n == 1, other).when(n == 2, F.concat(F.lit("�"), F.substr(a, F.lit(2)))).otherwise(F.concat(a, F.lit(" "), a))
    was, now = amended(F.col("raw"), a, F.col("b"))
    rows = words(t).withColumns({"b": other, "raw": raw}).select("raw", was.alias("registered"), now.alias("amended"))
    wrong = F.raise_error(F.lit("an output without U+FFFD changed")).cast("boolean")
    rows = rows.where(F.when((F.col("registered") != F.col("amended")) & ~F.col("raw").contains("�"), wrong).otherwise(F.lit(True)))
    return rows.groupBy("registered", "amended").agg(F.count("*").alias("rows"), F.sum(F.length("raw")).alias("codepoints"))


@query("CMP28_FLT7_headlines_by_text_form")
def headlines(t: Tables) -> DataFrame:
    """Of each cell the outputs that ended and don't repeat their tail, as the raw text, the structural one and the one without tags say, and those that a form decides otherwise."""
    r = records(t.documents)
    forms = {"raw": F.col("output"), "structural": X.normalize_markup(G.text_udf(G.unwrap_structure)("output")), "tags_stripped": X.strip_tags(F.col("output"))}
    flags = r.select("task", "prompt", *((~F.col("capped") & ~K.repetitive_udf()(f)).alias(n) for n, f in forms.items()))
    return flags.groupBy("task", "prompt").agg(F.count("*").alias("items"), *(F.count_if(n).alias(n) for n in forms), *(F.count_if(F.col(n) != F.col("raw")).alias(f"{n}_differs") for n in list(forms)[1:]))


# Frozen lists and seeds --------------------------------------------------------------------------------------------------------------


def frozen(df: DataFrame, item: str, ids: DataFrame, order: list[Column], sha256: str | None = None) -> DataFrame:
    """The rows of a declared list, in a stable order; ids that are not there, that repeat, or a list with other bytes than were frozen fail."""
    ids = guards.assert_unique(ids.select(item), [item])
    listed = [str(r[0]) for r in ids.orderBy(item).collect()]  # a declared list
    if sha256 is not None:
        import hashlib

        if hashlib.sha256("\n".join(listed).encode()).hexdigest() != sha256:
            raise guards.GuardError("the frozen list has other bytes")
    if ids.join(df, item, "left_anti").limit(1).count():
        raise guards.GuardError("a declared id is missing")
    return df.join(F.broadcast(ids), item, "left_semi").orderBy(*order)


@query("CMP35_CMP41_frozen_subset", "select doc_id, lang, n_chars from documents where lang = 'en' order by sha256('9:' || doc_id), doc_id limit 40")
def frozen_subset(t: Tables) -> DataFrame:
    """The declared subset of one split: the first forty of its documents in a digest's order."""
    split = t.documents.where("lang = 'en'").select("doc_id", "lang", "n_chars")
    declared = t.documents.where("lang = 'en'").orderBy(X.digest(9, F.col("doc_id")), "doc_id").limit(40).select("doc_id")
    return frozen(split, "doc_id", declared, [F.col("doc_id")])


@query("BOO23_seeds_by_label", f"""with g as (select lang, source, avg(n_chars) as v, ('0x' || substr(sha256('7:' || lang), 1, 8))::bigint as seed from documents group by all), n as (select *, row_number() over (partition by lang order by source) - 1 as k, count(*) over (partition by lang) as m from g),
    p as (select lang, draw, k, count(*) as weight from (select lang, draw, ('0x' || substr(sha256(seed || ':' || draw || ':' || s), 1, 8))::bigint % m as k from (select lang, seed, m, draw, unnest(range(m)) as s from (select distinct lang, seed, m from n), (select unnest(range({DRAWS})) as draw))) group by all),
    d as (select lang, draw, round(sum(v * weight) / sum(weight), 6) as v from p join n using (lang, k) group by all)
    select lang, any_value(seed) as seed, round(quantile_cont(d.v, 0.025), 4) as ci_low, round(quantile_cont(d.v, 0.975), 4) as ci_high from d join (select distinct lang, seed from g) using (lang) group by lang""")
def label_seeds(t: Tables) -> DataFrame:
    """A seed for each label from a digest of it, so that a label's draws are its own and never hang on which others there are."""
    g = t.documents.groupBy("lang", "source").agg(F.avg("n_chars").alias("v")).withColumn("seed", X.digest_number(X.digest(7, F.col("lang"))))
    c = B.cluster_sums(g, "source", ["lang", "seed"], {"v": F.col("v")})
    slots = c.select("lang", "seed", "_m").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long") - 1)))
    pick = X.digest_number(F.sha2(F.concat_ws(":", *(F.col(x).cast("string") for x in ("seed", "draw", "_s"))), 256)) % F.col("_m")
    plan = slots.withColumn("_k", pick).groupBy("lang", "seed", "draw", "_k").agg(F.count("*").alias("weight"))
    means = plan.join(c, ["lang", "seed", "_k"]).groupBy("lang", "seed", "draw").agg(F.round(F.sum(F.col("v") * F.col("weight")) / F.sum("weight"), 6).alias("v"))
    return means.groupBy("lang", "seed").agg(F.round(F.percentile("v", 0.025), 4).alias("ci_low"), F.round(F.percentile("v", 0.975), 4).alias("ci_high"))
