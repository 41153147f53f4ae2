"""Contrast families under shared resample plans: views of pages, a model and budget panel, arms against each other, margins, rank correlations.

Sources are the clusters. What a run would have recorded is derived from document ids by arithmetic that SQL repeats; it is unrelated to
sources, which go by the ids' last digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import contrasts as C
from tallyloom.operators import mixed as M
from tallyloom.operators import resample as B
from tallyloom.plans import observations as O
from tallyloom.plans import rules
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.resampling import DRAWS

_ID = "(doc_id % 1000003)"


def plan_sql(seed: int, clusters: str, at: str = "", column: str = "source") -> str:
    """Common table expressions c and plan over the distinct values of a column of a table."""
    return f"""c{at} as (select {column}, row_number() over (order by {column}) - 1 as k, count(*) over () as m from (select distinct {column} from {clusters})),
    plan{at} as (select draw, k, count(*) as weight from (select draw, ('0x' || substr(sha256('{seed}:' || draw || ':' || s), 1, 8))::bigint % m as k from (select m, draw, unnest(range(m)) as s from (select distinct m from c{at}), (select unnest(range({DRAWS})) as draw))) group by all)"""


def sized_plan_sql(seed: int, sizes: str) -> str:
    """plan (m, draw, k, weight) for each number of clusters in a table of m."""
    return f"plan as (select m, draw, k, count(*) as weight from (select m, draw, ('0x' || substr(sha256('{seed}:' || draw || ':' || s), 1, 8))::bigint % m as k from (select m, draw, unnest(range(m)) as s from (select distinct m from {sizes}), (select unnest(range({DRAWS})) as draw))) group by all)"


# Views of pages -----------------------------------------------------------------------------------------------------------------

#: Views and how many lines in a thousand each one reads as text.
VIEWS = {"baseline": 380, "repeat": 400, "pad": 390, "scale90": 410, "pad12": 300, "scale75": 310, "masked_bands": 560, "bands100": 470, "bands": 590}
_BIT = {v: 1 << k for k, v in enumerate(VIEWS)}


def _has(*views: str, mask: str = "text") -> str:
    return f"(case when ({mask} & {sum(_BIT[v] for v in views)}) <> 0 then 1 else 0 end)"


def _gain(view: str) -> str:
    return f"(case when (text & {_BIT[view]}) <> 0 and (text & {_BIT['baseline']}) = 0 then 1 else 0 end)"


W3, W5 = ("repeat", "pad", "scale90"), ("repeat", "pad", "scale90", "pad12", "scale75")
_N = f"({_gain('pad')} + {_gain('scale90')}) / 2.0"
#: Effects on the marks of absent lines, as weights of masks that Spark and SQL both read.
EFFECTS = {
    "C1_masked_minus_repeat": f"{_has('masked_bands')} - {_has('repeat')}",
    "C2_bands100_minus_repeat": f"{_has('bands100')} - {_has('repeat')}",
    "C3_bands100_minus_masked": f"{_has('bands100')} - {_has('masked_bands')}",
    "D1_masked_minus_W3": f"{_has('masked_bands')} - {_has(*W3)}",
    "D2_masked_minus_W5": f"{_has('masked_bands')} - {_has(*W5)}",
    "Z_zoom_gain": _gain("bands"),
    "N_perturbation_gain": _N,
    "Z_minus_N": f"{_gain('bands')} - {_N}",
    "D_zoom_text": f"{_has('bands')} - {_has('bands100')}",
    "D_zoom_any": f"{_has('bands')} + {_has('bands', mask='figure')} - {_has('bands100')} - {_has('bands100', mask='figure')}",
    "D_zoom_figure": f"{_has('bands', mask='figure')} - {_has('bands100', mask='figure')}",
    "union_W3": _has(*W3),
    "union_W5": _has(*W5),
    "union_all": _has(*VIEWS),
} | {f"text_{v}": _has(v) for v in VIEWS} | {f"net_{v}": f"{_has(v)} - {_has('baseline')}" for v in VIEWS if v != "baseline"} | {f"churn_{v}": f"abs({_has(v)} - {_has('baseline')})" for v in VIEWS if v != "baseline"}

_VIEW_LINES = f"""views as (select unnest({list(VIEWS)}) as view, unnest({list(_BIT.values())}) as bit, unnest({list(VIEWS.values())}) as share, unnest({list(range(len(VIEWS)))}) as v),
    seen as (select source, doc_id, bit, 1 + n_chars % 7 as marks, {_ID} * 6301 % 1000 < 250 as control, ({_ID} * 37 + v * 101) * 7919 % 1000 - share - case when {_ID} * 6301 % 1000 < 250 then 450 else 0 end as o from documents, views),
    line as (select source, doc_id, control, marks, sum(bit) filter (o < 0) as text, sum(bit) filter (o >= 0 and o < 100) as figure from seen group by all),
    h as (select source, control, coalesce(text, 0)::bigint as text, coalesce(figure, 0)::bigint as figure, sum(marks) as marks from line group by all)"""
_ABSENT = f"{_VIEW_LINES}, absent as (select * from h where not control), {plan_sql(91, 'absent')}, each as (select draw, text, figure, sum(marks * weight) as marks from plan join c using (k) join absent using (source) group by all)"


def _shares_sql(table: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return " union all ".join(f"select {lead}'{n}' as effect, round(coalesce(sum(marks * ({w})) / nullif(sum(marks), 0), 0), 9) as v from {table}{' group by ' + by if by else ''}" for n, w in EFFECTS.items())


def view_masks(t: Tables) -> DataFrame:
    """source, group, text, figure, marks: documents as lines of pages (sources), read by all views."""
    views = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.lit(s).alias("share"), F.lit(k).alias("v")) for k, (v, s) in enumerate(VIEWS.items()))))
    control = (F.col("doc_id") % 1000003) * 6301 % 1000 < 250
    place = ((F.col("doc_id") % 1000003) * 37 + F.col("_v.v") * 101) * 7919 % 1000 - F.col("_v.share") - F.when(control, 450).otherwise(0)
    outcome = F.when(place < 0, "text").when(place < 100, "figure_only").otherwise("not_found")
    lines = t.documents.select("source", "doc_id", "n_chars", views.alias("_v")).select("source", "doc_id", F.col("_v.view").alias("view"), F.when(control, "control").otherwise("absent").alias("group"), (1 + F.col("n_chars") % 7).alias("marks"), outcome.alias("outcome"))
    return C.mask_counts(lines, "source", "doc_id", list(VIEWS))


@query("BOO14_CMP9_CMP10_AGG42_AGG44_view_contrasts", f"""with {_ABSENT}, v as ({_shares_sql('each', 'draw')}), e as ({_shares_sql('absent')}),
    q as (select effect, list_sort(list(v)) as s, count(*) as n from v group by 1)
    select effect, e.v as estimate, s[floor(0.025 * n)::int + 1] as ci_low, s[floor(0.975 * n)::int] as ci_high from e join q using (effect)""")
def view_contrasts(t: Tables) -> DataFrame:
    """Shares of absent marks that views read, alone, joined and against each other, with paired page bootstraps."""
    absent = view_masks(t).where("group = 'absent'")
    return C.mask_bootstrap(absent, "source", {n: F.expr(w) for n, w in EFFECTS.items()}, DRAWS, 91)


_MATERIAL = "(max(ci_low) filter (effect = '{0}') > 0 and max(v) filter (effect = '{0}') >= 0.05)"


@query("CMP9_CMP10_DEC9_DEC10_DEC11_DEC12_view_readings", f"""with {_ABSENT}, v as ({_shares_sql('each', 'draw')}), e as ({_shares_sql('absent')}), ctl as ({_shares_sql('(select * from h where control)')}),
    q as (select effect, list_sort(list(v)) as s, count(*) as n from v group by 1), x as (select effect, e.v, s[floor(0.025 * n)::int + 1] as ci_low, s[floor(0.975 * n)::int] as ci_high from e join q using (effect)),
    r as (select {', '.join(f"{_MATERIAL.format(n)} as m{k}" for k, n in enumerate(('C1_masked_minus_repeat', 'C2_bands100_minus_repeat', 'C3_bands100_minus_masked', 'D1_masked_minus_W3')))},
        max(v) filter (effect = 'D1_masked_minus_W3') as d1, max(ci_high) filter (effect = 'D1_masked_minus_W3') as d1_high, max(v) filter (effect = 'Z_zoom_gain') as z, max(v) filter (effect = 'N_perturbation_gain') as n,
        max(v) filter (effect = 'D_zoom_text') as d, max(ci_low) filter (effect = 'D_zoom_text') as d_low, max(ci_high) filter (effect = 'D_zoom_text') as d_high from x),
    k as (select max(v) filter (effect = 'text_masked_bands') as masked, max(v) filter (effect = 'text_bands') as bands, max(v) filter (effect = 'text_bands100') as crop, bool_or(v < 0.8) filter (effect in ('text_repeat', 'text_pad', 'text_scale90', 'text_masked_bands')) as qualified from ctl)
    select case when masked < 0.8 then 'masked_damages_ordinary_reading' when m0 and m2 then 'both_contribute' when m0 then 'competing_content' when m1 and m2 then 'image_size_or_token_count' when not m0 and not m1 then 'crop_effect_not_reproduced' else 'not_distinguishable' end as masking,
        case when m3 then 'masking_adds_beyond_read_count' when d1_high < 0 and d1 <= -0.05 then 'whole_page_reads_recover_more' else 'read_count_accounts_for_gain' end || case when qualified then '_qualified' else '' end as read_count,
        case when bands < 0.8 then 'instrument_fails_control' when z >= 0.1 and z - n >= 0.1 then 'zoom_adds_beyond_perturbation' when n >= 0.1 then 'perturbation_explains_gain' else 'no_gain_from_views' end as views,
        case when crop < 0.8 then 'instrument_fails_control' when d >= 0.1 and d_low > 0 then 'zoom_helps' when d <= -0.1 and d_high < 0 then 'zoom_hurts' else 'zoom_not_distinguishable' end as controlled from r, k""")
def view_readings(t: Tables) -> DataFrame:
    """What the contrasts say, by the rules that were fixed before; a page's control lines must be read."""
    masks = view_masks(t)
    weights = {n: F.expr(w) for n, w in EFFECTS.items()}
    x = {r["effect"]: r.asDict() for r in C.mask_bootstrap(masks.where("group = 'absent'"), "source", weights, DRAWS, 91).collect()}  # one row an effect
    k = masks.where("group = 'control'").agg(*(F.coalesce(F.try_divide(F.sum(F.col("marks") * weights[f"text_{v}"]), F.sum("marks")), F.lit(0.0)).alias(v) for v in VIEWS)).first()
    qualified = any(k[v] < rules.CONTROL_FLOOR for v in (*W3, "masked_bands"))
    m = [rules.material(x[n]) for n in ("C1_masked_minus_repeat", "C2_bands100_minus_repeat", "C3_bands100_minus_masked")]
    row = (
        rules.masking_reading(*m, k["masked_bands"]), rules.read_count_reading(x["D1_masked_minus_W3"], qualified),
        rules.views_reading(x["Z_zoom_gain"]["estimate"], x["N_perturbation_gain"]["estimate"], k["bands"]), rules.controlled_reading(x["D_zoom_text"], k["bands100"]),
    )
    return t.spark.createDataFrame([row], "masking string, read_count string, views string, controlled string")


# A panel of models and budgets ----------------------------------------------------------------------------------------------------

MODELS, BUDGETS, RENDERS = ("BASE", "SPECIALIZED"), ("B256_FULL", "B196", "B121", "B64"), 8
#: Items in a thousand that a model reads under a budget.
RATES = {("BASE", "B256_FULL"): 800, ("BASE", "B196"): 770, ("BASE", "B121"): 700, ("BASE", "B64"): 520, ("SPECIALIZED", "B256_FULL"): 850, ("SPECIALIZED", "B196"): 840, ("SPECIALIZED", "B121"): 800, ("SPECIALIZED", "B64"): 730}
_FULL = BUDGETS[0]
#: Contrasts as weighted cells: what a budget costs the one model more than the other, and each model by itself.
DIDS = {f"DID_{b[1:]}": {("SPECIALIZED", b): 1.0, ("SPECIALIZED", _FULL): -1.0, ("BASE", b): -1.0, ("BASE", _FULL): 1.0} for b in BUDGETS[1:]}
CHANGES = {f"{m}_{b[1:]}": {(m, b): 1.0, (m, _FULL): -1.0} for m in MODELS for b in BUDGETS[1:]}
_PANEL = f"""arm as (select unnest({[m for m, _ in RATES]}) as model, unnest({[b for _, b in RATES]}) as budget, unnest({list(RATES.values())}) as rate, unnest({list(range(len(RATES)))}) as a),
    rows as (select source, lang, model, budget, r, (({_ID} * 31 + a * 17 + r * 13) * ({_ID} * 31 + a * 17 + r * 13) % 10007 % 1000 < rate)::int as ok from documents, arm, (select unnest(range({RENDERS})) as r)),
    cell as (select source, model, budget, avg(ok) as mean from rows group by all)"""


def _weight_sql(terms: dict) -> str:
    return " + ".join(f"{w} * max(mean) filter (model = '{m}' and budget = '{b}')" for (m, b), w in terms.items())


_VECTORS = f"vec as (select source, {', '.join(f'{_weight_sql(x)} as {n}' for n, x in (DIDS | CHANGES).items())} from cell group by source)"
_NAMES = [*DIDS, *CHANGES]
_DRAWN = f"d as (select draw, {', '.join(f'round(sum({n} * weight) / sum(weight), 9) as {n}' for n in _NAMES)} from plan join c using (k) join vec using (source) group by draw), e as (select {', '.join(f'round(sum({n}) / count(*), 9) as {n}' for n in _NAMES)}, count(*) as clusters from vec)"


def panel(t: Tables) -> DataFrame:
    """source, lang, model, budget, render, ok: each document in eight renders under each model and budget."""
    arms = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(b).alias("budget"), F.lit(r).alias("rate"), F.lit(k).alias("a")) for k, ((m, b), r) in enumerate(RATES.items()))))
    rows = t.documents.select("source", "lang", "doc_id", arms.alias("_a")).select("source", "lang", "doc_id", "_a.*", F.explode(F.sequence(F.lit(0), F.lit(RENDERS - 1))).alias("render"))
    x = (F.col("doc_id") % 1000003) * 31 + F.col("a") * 17 + F.col("render") * 13
    ok = x * x % 10007 % 1000 < F.col("rate")
    return rows.select("source", "lang", "model", "budget", "render", ok.cast("int").alias("ok"))


def panel_vectors(rows: DataFrame) -> DataFrame:
    """source and each contrast, from cells of exactly eight renders."""
    return C.vectors(C.cells(rows, "source", ["model", "budget"], "render", F.col("ok"), RENDERS), "source", DIDS | CHANGES, ["model", "budget"])


@query("DID5_BOO7_PVL2_PVL5_panel_family", f"""with {_PANEL}, {_VECTORS}, {plan_sql(92, 'vec')}, {_DRAWN},
    l as (unpivot (select draw, {', '.join(_NAMES)} from d) on {', '.join(_NAMES)} into name contrast value v), p as (unpivot e on {', '.join(_NAMES)} into name contrast value estimate),
    s as (select contrast, clusters, any_value(estimate) as estimate, quantile_cont(v, 0.025) as ci_low, quantile_cont(v, 0.975) as ci_high, case when contrast like 'DID%' then (1 + count(*) filter (round(abs(v - estimate), 9) >= abs(estimate))) / (1 + count(*)) end as p from l join p using (contrast) group by contrast, clusters),
    h as (select *, least(1.0, (count(p) over () - row_number() over (order by p nulls last) + 1) * p) as raw from s)
    select contrast, clusters, estimate, round(ci_low, 7) as ci_low, round(ci_high, 7) as ci_high, round(p, 9) as p, round(case when p is not null then max(raw) over (order by p nulls last rows unbounded preceding) end, 9) as p_holm from h""")
def panel_family(t: Tables) -> DataFrame:
    """Difference-in-differences of a model's loss under each budget, by one plan over sources, and each model's own change."""
    point, draws = C.drawn_means(panel_vectors(panel(t)), "source", _NAMES, DRAWS, 92)
    r = lambda c: F.round(c, 9).alias(c)
    return C.family(point, draws, _NAMES, list(DIDS)).select("contrast", "clusters", "estimate", "ci_low", "ci_high", r("p"), r("p_holm"))


_D3 = list(DIDS)
_COV = {(a, b): f"covar_samp({a}, {b})" for i, a in enumerate(_D3) for b in _D3[i:]}


def _inverse_sql() -> str:
    """Estimates times the inverse of a symmetric 3 x 3 matrix times estimates, by cofactors."""
    x, y, z = _D3
    m = {f"{a}{b}": f"c{min(a, b)}{max(a, b)}" for a in range(3) for b in range(3)}
    cof = lambda i, j: "({0} * {3} - {1} * {2})".format(*(m[f"{r}{c}"] for r in range(3) if r != i for c in range(3) if c != j))
    sign = lambda i, j: "-" if (i + j) % 2 else ""
    det = " + ".join(f"{m[f'0{j}']} * {sign(0, j)}{cof(0, j)}" for j in range(3))
    form = " + ".join(f"{_D3[i]} * {_D3[j]} * {sign(i, j)}{cof(i, j)}" for i in range(3) for j in range(3))
    return f"({form}) / ({det})"


@query("PVL9_DID5_wald_test", f"""with {_PANEL}, {_VECTORS}, {plan_sql(92, 'vec')}, {_DRAWN},
    k as (select {', '.join(f'{x} as c{_D3.index(a)}{_D3.index(b)}' for (a, b), x in _COV.items())} from d), w as (select k.*, e.*, {_inverse_sql()} as w from k, e),
    z as (select *, sqrt(w / 2) as z from w)
    select 'ESTIMABLE' as status, 3 as df, round(w, 4) as statistic, case when w > 200 then 0.0 else round(1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(200), lambda n: z * list_product(list_transform(range(1, n + 1), lambda j: 2 * z * z / (2 * j + 1))))) + sqrt(2 * w / pi()) * exp(-w / 2), 6) end as p,
        {', '.join(f'round(c{_D3.index(a)}{_D3.index(b)}, 9) as cov_{a}_{b}' for a, b in _COV)} from z""")
def wald(t: Tables) -> DataFrame:
    """One global test of all three difference-in-differences by the covariance of their draws; a singular one is said so."""
    point, draws = C.drawn_means(panel_vectors(panel(t)), "source", _D3, DRAWS, 92)
    e, k = point.first(), C.covariances(draws, _D3).first()  # one row each
    status, statistic, p = rules.wald_of([e[n] for n in _D3], [[k[f"cov_{_D3[min(i, j)]}_{_D3[max(i, j)]}"] for j in range(3)] for i in range(3)])
    names = [f"cov_{a}_{b}" for a, b in _COV]
    row = [(status, 3, None if statistic is None else round(statistic, 4), None if p is None else round(p, 6), *(round(k[n], 9) for n in names))]
    return t.spark.createDataFrame(row, "status string, df int, statistic double, p double, " + ", ".join(f"{n} double" for n in names))


@query("DID6_component_descriptives", f"""with {_PANEL}, g as (select lang, model, budget, source, avg(ok) as v, 1 as one from rows group by all),
    n as (select *, row_number() over (partition by lang, model, budget order by source) - 1 as k, count(*) over (partition by lang, model, budget) as m from g), {sized_plan_sql(93, 'n')},
    d as (select lang, model, budget, draw, round(sum(v * weight) / sum(one * weight), 9) as v from plan join n using (m, k) group by all), q as (select lang, model, budget, quantile_cont(v, 0.025) as ci_low, quantile_cont(v, 0.975) as ci_high from d group by all)
    select lang as component, model, budget, round(sum(v) / count(*), 9) as mean, round(any_value(ci_low), 7) as ci_low, round(any_value(ci_high), 7) as ci_high, count(*) as pairs from g join q using (lang, model, budget) group by all""")
def descriptives(t: Tables) -> DataFrame:
    """Mean and interval over a component's pairs of each model under each budget. Components (here languages) are drawn apart."""
    keys = ["lang", "model", "budget"]
    rows = panel(t).withColumn("_pair", F.concat_ws("|", "lang", "source"))
    cells = C.cells(rows, "_pair", ["lang", "source", "model", "budget"], "render", F.col("ok"), RENDERS).select(*keys, "source", F.col("mean").alias("v"), F.lit(1).alias("one"))
    out = C.group_estimates(cells, "source", {"mean": ("v", "one")}, DRAWS, 93, keys, C.linear_ends)
    return out.select(F.col("lang").alias("component"), "model", "budget", F.col("estimate").alias("mean"), "ci_low", "ci_high", "pairs")


# Arms against each other ----------------------------------------------------------------------------------------------------------

LEVELS = ("75", "50", "25")
#: Families: which arm less which (None: by itself), over which regions, and whether Holm's correction holds.
FAMILIES = {"DID": ("A", "B", False, True), "DID_FULL_ZERO": ("A", "B", True, False), "CONTRAST_B_A": ("B", "A", False, True), "MARGINAL_A": ("A", None, False, True), "CONTRAST_C_A": ("C", "A", False, True)}


def arm_table(arms: DataFrame) -> DataFrame:
    """doc_id, source, condition_id, cer. FULL reads one line in seven with what `pairs` derives for it, the others without error."""
    full = F.when(F.col("doc_id") % 7 == 0, O.hypothesis(F.col("reference"), F.col("doc_id"))).otherwise(F.col("reference"))
    hyp = F.when(F.col("condition_id") == "FULL", full).otherwise(F.col("hypothesis"))
    return arms.select("doc_id", "source", "condition_id", (X.edit_distance(F.col("reference"), hyp) / F.length("reference")).alias("cer"))


def contrast_families(table: DataFrame, families=FAMILIES, levels=LEVELS, draws: int = DRAWS, seed: int = 94) -> DataFrame:
    """family, budget, status, regions, clusters, estimate, ci_low, ci_high, p, p_holm.

    Each family takes the regions that have all its conditions and FULL, and draws their clusters once for all its budgets. Families
    whose conditions are in no row, or in no region together, say so in a row of their own instead of failing. p is centred on the
    draws' mean. Holm's correction holds within a family and never across.
    """
    present = {r[0] for r in table.select("condition_id").distinct().collect()}  # as many as there are arms
    wanted = {name: [f"{x}_{v}" for x in (a, b) if x for v in levels] for name, (a, b, _, _) in families.items()}
    lacking = [(name, "CONDITIONS_NOT_PRESENT") for name, needs in wanted.items() if {"FULL", *needs} - present]
    wide = table.groupBy("doc_id", "source").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("condition_id") == c, F.col("cer"))).alias(c) for c in sorted(present)))
    parts = []
    for name, needs in wanted.items():
        if {"FULL", *needs} - present:
            continue
        a, b, zero, _ = families[name]
        rows = wide.where(F.col("FULL").isNotNull() & (F.col("FULL") == 0 if zero else F.lit(True)))
        for c in needs:
            rows = rows.where(F.col(c).isNotNull())
        delta = {v: F.col(f"{a}_{v}") - (F.col(f"{b}_{v}") if b else F.col("FULL")) for v in levels}
        parts.append(rows.groupBy("source").agg(*(F.sum(d).alias(f"s{v}") for v, d in delta.items()), F.count("*").alias("regions")).select(F.lit(name).alias("family"), "source", *(f"s{v}" for v in levels), "regions"))
    spark = table.sparkSession
    kinds = "family string, budget string, status string, regions long, clusters long, estimate double, ci_low double, ci_high double, p double, p_holm double"
    none = spark.createDataFrame([(n, None, s, *[None] * 7) for n, s in lacking], kinds)
    if not parts:
        return none
    sums = parts[0]
    for x in parts[1:]:
        sums = sums.unionByName(x)
    point, v = C.group_draws(sums, "source", {v: (f"s{v}", "regions") for v in levels}, draws, seed, ["family"])
    sizes = sums.groupBy("family").agg(F.sum("regions").alias("regions"), F.count("*").alias("clusters"))
    middle = v.groupBy("family", "statistic").agg(F.round(F.avg("v"), C.DIGITS).alias("_mean"))
    low, high = C.linear_ends(F.col("v"))
    far = F.count_if(F.round(F.abs(F.col("v") - F.col("_mean")), C.DIGITS) >= F.abs(F.col("_mean"))) / F.count("v")
    ends = v.join(F.broadcast(middle), ["family", "statistic"]).groupBy("family", "statistic").agg(low.alias("ci_low"), high.alias("ci_high"), F.round(far, 9).alias("p"))
    held = F.col("family").isin(*(n for n, f in families.items() if f[3]))
    done = B.holm(point.join(ends, ["family", "statistic"]), "p", ["family"]).join(sizes, "family")
    out = done.select("family", F.col("statistic").alias("budget"), F.lit("ANALYSED").alias("status"), "regions", "clusters", "estimate", "ci_low", "ci_high", "p", F.round(F.when(held, F.col("p_holm")), 9).alias("p_holm"))
    empty = [n for n in families if n not in {x for x, _ in lacking}]
    missing = spark.createDataFrame([(n,) for n in empty], "family string").join(sizes.select("family"), "family", "left_anti")
    return out.unionByName(none).unionByName(missing.select("family", *(F.lit("NO_COMPLETE_ROWS" if c == "status" else None).cast(k).alias(c) for c, k in (x.split() for x in kinds.split(", ")[1:]))))


def _family_sql() -> str:
    parts = []
    for name, (a, b, zero, _) in FAMILIES.items():
        if name == "CONTRAST_C_A":
            continue
        needs = " and ".join(f"{x}_{v} is not null" for x in (a, b) if x for v in LEVELS)
        sums = ", ".join(f"sum({a}_{v} - {f'{b}_{v}' if b else 'FULL_'}) as s{v}" for v in LEVELS)
        parts.append(f"select '{name}' as family, source, {sums}, count(*) as regions from w where FULL_ is not null and {needs}{' and FULL_ = 0' if zero else ''} group by source")
    return " union all ".join(parts)


@query("DID2_DID3_DID4_PVL1_PVL4_arm_families", f"""with {O.ARMS_SQL}, t as (select doc_id, source, condition_id, levenshtein(reference, case when condition_id <> 'FULL' then hypothesis when doc_id % 7 <> 0 then reference when doc_id % 3 = 0 then replace(reference, 'e', '') else reference || 'x' end) / length(reference) as cer from arms),
    w as (select doc_id, source, {', '.join(f"max(cer) filter (condition_id = '{c}') as {c}{'_' if c == 'FULL' else ''}" for c in O.ARMS)} from t group by all), g as ({_family_sql()}),
    n as (select *, row_number() over (partition by family order by source) - 1 as k, count(*) over (partition by family) as m from g), {sized_plan_sql(94, 'n')},
    d as (select family, draw, {', '.join(f'round(sum(s{v} * weight) / sum(regions * weight), 9) as "{v}"' for v in LEVELS)} from plan join n using (m, k) group by all), l as (unpivot d on "75", "50", "25" into name budget value v),
    mean as (select family, budget, round(avg(v), 9) as mu from l group by all), q as (select family, budget, round(quantile_cont(v, 0.025), 7) as ci_low, round(quantile_cont(v, 0.975), 7) as ci_high, round(count(*) filter (round(abs(v - mu), 9) >= abs(mu)) / count(*), 9) as p from l join mean using (family, budget) group by all),
    e as (select family, sum(regions)::bigint as regions, count(*) as clusters, {', '.join(f'round(sum(s{v}) / sum(regions), 9) as "{v}"' for v in LEVELS)} from g group by all), p as (unpivot e on "75", "50", "25" into name budget value estimate),
    h as (select *, least(1.0, (3 - row_number() over (partition by family order by p) + 1) * p) as raw from p join q using (family, budget))
    select family, budget, 'ANALYSED' as status, regions, clusters, estimate, ci_low, ci_high, p, round(case when family <> 'DID_FULL_ZERO' then max(raw) over (partition by family order by p rows unbounded preceding) end, 9) as p_holm from h
    union all select 'CONTRAST_C_A', null, 'CONDITIONS_NOT_PRESENT', null, null, null, null, null, null, null""")
def arm_families(t: Tables) -> DataFrame:
    return contrast_families(arm_table(O.arms(t.documents)))


# Margins --------------------------------------------------------------------------------------------------------------------------

#: Groups of rows: all, components (languages), conditions, members.
GROUPS = {"overall": (), "component": ("lang",), "condition": ("lang", "font", "size"), "member": ("lang", "member")}
RATIOS = {"correct_margin": ("cm", "n"), "blank_margin": ("bm", "n"), "image_gain": ("gain", "n"), "gain_positive": ("pos", "n"), "accuracy": ("ok", "n"), "position_margin": ("pm", "blanks"), "chose_a": ("chose_a", "blanks")}
_MARGIN_SQL = f"""rows as (select source, lang, ({_ID} * 3571 % 1000 >= 500)::int as font, case when {_ID} * 1237 % 1000 < 500 then 72 else 96 end as size, ({_ID} * 2749 % 1000 >= 500)::int as member, {_ID} * 6301 % 1000 < 200 as blank,
    {_ID} * 7919 % 1000 - 400 as cm, {_ID} * 10473 % 1000 - 500 as bm, {_ID} * 3571 % 1000 - 480 as pm from documents)"""
_MARGIN_SUMS = {"cm": ("cm", False), "bm": ("bm", False), "gain": ("cm - bm", False), "pos": ("case when cm > bm then 1 else 0 end", False), "ok": ("case when cm > 0 then 1 else 0 end", False), "n": ("1", False), "pm": ("pm", True), "chose_a": ("case when pm > 0 then 1 else 0 end", True), "blanks": ("1", True)}


def margins(t: Tables) -> DataFrame:
    """Forced choices: margins in thousandths of the right answer, of the matched blank and, for blank controls, of the first place."""
    i = F.col("doc_id") % 1000003
    half = lambda k: i * k % 1000 >= 500
    return t.documents.select(
        "source", "lang", "doc_id", half(3571).cast("int").alias("font"), F.when(half(1237), 96).otherwise(72).alias("size"), half(2749).cast("int").alias("member"), (i * 6301 % 1000 < 200).alias("blank"),
        (i * 7919 % 1000 - 400).alias("cm"), (i * 10473 % 1000 - 500).alias("bm"), (i * 3571 % 1000 - 480).alias("pm"),
    )


def _level_sql() -> str:
    levels = {"overall": "'all'", "component": "lang", "condition": "lang || '|' || font || '|' || size", "member": "lang || '|' || member"}
    sums = ", ".join(f"coalesce(sum({x}) filter ({'blank' if b else 'not blank'}), 0) as {n}" for n, (x, b) in _MARGIN_SUMS.items())
    return " union all ".join(f"select '{k}' as kind, {v} as level, source, {sums} from rows group by all" for k, v in levels.items())


_RATIO_SQL = ", ".join(f"round(sum({x} * weight) / nullif(sum({y} * weight), 0), 9) as {n}" for n, (x, y) in RATIOS.items())


@query("CMP16_CMP17_BOO4_margin_groups", f"""with {_MARGIN_SQL}, g as ({_level_sql()}), n as (select *, row_number() over (partition by kind, level order by source) - 1 as k, count(*) over (partition by kind, level) as m from g), {sized_plan_sql(95, 'n')},
    d as (select kind, level, draw, {_RATIO_SQL} from plan join n using (m, k) group by all), l as (unpivot d on {', '.join(RATIOS)} into name statistic value v), q as (select kind, level, statistic, list_sort(list(v)) as s, count(*) as n from l where v is not null group by all),
    e as (select kind, level, count(*) as pairs, {', '.join(f'round(sum({x}) / nullif(sum({y}), 0), 9) as {n}' for n, (x, y) in RATIOS.items())} from g group by all), p as (select * from e unpivot include nulls (estimate for statistic in ({', '.join(RATIOS)})))
    select kind, level, statistic, pairs, estimate, s[floor(0.025 * n)::int + 1] as ci_low, s[greatest(1, floor(0.975 * n))::int] as ci_high from p left join q using (kind, level, statistic)""")
def margin_groups(t: Tables) -> DataFrame:
    """Margins, gains over the blank and choices in all groups at once. Groups of the same pairs share their draws."""
    sums = {n: F.coalesce(F.when(F.col("blank") == b, F.expr(x)), F.lit(0)) for n, (x, b) in _MARGIN_SUMS.items()}
    return C.group_estimates(C.marginal_groups(margins(t), "source", GROUPS, sums), "source", RATIOS, DRAWS, 95)


_PAIRED = {"size_accuracy": ("case when cm > 0 then 1 else 0 end", "size = 96", "size = 72"), "size_gain": ("cm - bm", "size = 96", "size = 72"), "font_accuracy": ("case when cm > 0 then 1 else 0 end", "font = 1", "font = 0"), "font_gain": ("cm - bm", "font = 1", "font = 0"), "member_margin": ("cm", "member = 0", "member = 1"), "member_gain": ("cm - bm", "member = 0", "member = 1")}


@query("CMP16_CMP19_BOO17_BOO18_paired_levels", f"""with {_MARGIN_SQL}, g as ({' union all '.join(f"select '{n}' as kind, source, avg({x}) filter ({a}) - avg({x}) filter ({b}) as v, 1 as one from rows where not blank group by source" for n, (x, a, b) in _PAIRED.items())}),
    n as (select *, row_number() over (partition by kind order by source) - 1 as k, count(*) over (partition by kind) as m from g), {sized_plan_sql(96, 'n')}, d as (select kind, draw, round(sum(v * weight) / sum(one * weight), 9) as v from plan join n using (m, k) group by all),
    q as (select kind, list_sort(list(v)) as s, count(*) as n from d group by all) select kind, count(*) as pairs, round(sum(v) / count(*), 9) as estimate, any_value(s[floor(0.025 * n)::int + 1]) as ci_low, any_value(s[floor(0.975 * n)::int]) as ci_high from g join q using (kind) group by kind""")
def paired_levels(t: Tables) -> DataFrame:
    """Differences between two levels within each pair, and their mean over drawn pairs; a pair that lacks a level fails the plan."""
    rows = margins(t).where(~F.col("blank"))
    each = C.paired_differences(rows, "source", {n: tuple(map(F.expr, x)) for n, x in _PAIRED.items()}).withColumn("one", F.lit(1))
    return C.group_estimates(each, "source", {"v": ("v", "one")}, DRAWS, 96, ["kind"]).select("kind", "pairs", "estimate", "ci_low", "ci_high")


# Diagnostics of a measurement -----------------------------------------------------------------------------------------------------

_DIAGNOSED = {"position_following": ("following", "n"), "corrected_correct": ("corrected", "n"), "retrieval_correct": ("retrieved", "n"), "rescue_gain": ("gain", "rescued")}
_DIAGNOSTIC_SUMS = {"following": "case when doc_id % 1000003 * 7919 % 1000 < 640 then 1 else 0 end", "corrected": "case when doc_id % 1000003 * 3571 % 1000 < 560 then 1 else 0 end", "retrieved": "case when doc_id % 1000003 * 1237 % 1000 < 580 then 1 else 0 end",
    "gain": "case when doc_id % 7 = 0 then (case when doc_id % 1000003 * 2749 % 1000 < 700 then 1 else 0 end) - (case when doc_id % 1000003 * 3571 % 1000 < 560 then 1 else 0 end) else 0 end", "n": "1", "rescued": "case when doc_id % 7 = 0 then 1 else 0 end"}
#: What position following and the signals must exceed.
INTERFACE_LOW, SIGNAL, RESCUE = 0.55, (0.55, 0.5), (0.10, 0.0)
_SIGNAL = "(max(estimate) filter (statistic = '{0}') >= {1} and max(ci_low) filter (statistic = '{0}') > {2})"


@query("CMP21_DEC3_BOO21_measurement_diagnostic", f"""with g as (select 'overall' as kind, 'all' as level, source, {', '.join(f'sum({x}) as {n}' for n, x in _DIAGNOSTIC_SUMS.items())} from documents group by source union all select 'component', lang, source, {', '.join(f'sum({x})' for x in _DIAGNOSTIC_SUMS.values())} from documents group by lang, source),
    n as (select *, row_number() over (partition by kind, level order by source) - 1 as k, count(*) over (partition by kind, level) as m from g), {sized_plan_sql(97, 'n')},
    d as (select kind, level, draw, {', '.join(f'round(sum({x} * weight) / nullif(sum({y} * weight), 0), 9) as {n}' for n, (x, y) in _DIAGNOSED.items())} from plan join n using (m, k) group by all), l as (unpivot d on {', '.join(_DIAGNOSED)} into name statistic value v),
    q as (select kind, level, statistic, list_sort(list(v)) as s, count(*) as n from l where v is not null group by all), e as (select kind, level, count(*) as pairs, {', '.join(f'round(sum({x}) / nullif(sum({y}), 0), 9) as {n}' for n, (x, y) in _DIAGNOSED.items())} from g group by all), p as (select * from e unpivot include nulls (estimate for statistic in ({', '.join(_DIAGNOSED)}))),
    o as (select kind, level, statistic, pairs, estimate, s[floor(0.025 * n)::int + 1] as ci_low, s[greatest(1, floor(0.975 * n))::int] as ci_high from p left join q using (kind, level, statistic)),
    f as (select coalesce(max(ci_low) filter (statistic = 'position_following') >= {INTERFACE_LOW}, false) as i, coalesce({_SIGNAL.format('corrected_correct', *SIGNAL)}, false) as a, coalesce({_SIGNAL.format('retrieval_correct', *SIGNAL)}, false) as r, coalesce({_SIGNAL.format('rescue_gain', *RESCUE)}, false) as s from o where kind = 'overall')
    select o.*, case when i and not a and s then 'mixed' when i and (a or r) then 'measurement/interface' when s and not (i or a or r) then 'visual representation' else 'inconclusive' end as root_cause from o, f""")
def diagnostic(t: Tables) -> DataFrame:
    """Four diagnostics by component and over all, with the cause that the overall ones point to."""
    rows = t.documents.select("source", "lang", *(F.expr(x).alias(n) for n, x in _DIAGNOSTIC_SUMS.items()))
    groups = C.marginal_groups(rows, "source", {"overall": (), "component": ("lang",)}, {n: F.col(n) for n in _DIAGNOSTIC_SUMS})
    out = C.group_estimates(groups, "source", _DIAGNOSED, DRAWS, 97)
    at = {r["statistic"]: r.asDict() for r in out.where("kind = 'overall'").collect()}  # one row a statistic
    cause = rules.root_cause(at["position_following"], at["corrected_correct"], at["retrieval_correct"], at["rescue_gain"], INTERFACE_LOW, SIGNAL, RESCUE)
    return out.withColumn("root_cause", F.lit(cause))


# Rank correlations ----------------------------------------------------------------------------------------------------------------

_MIDRANK = "sum(w) over (partition by draw order by {0}) - w + (w + 1) / 2"
_RHO = """(sum(w * a * b) - sum(w) * ((sum(w) + 1) / 2) * ((sum(w) + 1) / 2)) / nullif(sqrt((sum(w * a * a) - sum(w) * ((sum(w) + 1) / 2) * ((sum(w) + 1) / 2)) * (sum(w * b * b) - sum(w) * ((sum(w) + 1) / 2) * ((sum(w) + 1) / 2))), 0)"""


@query("BOO19_CMP19_spearman", f"""with r as (select source, n_chars // 400 as x, quality * 2 + toxic as y from documents join labels using (doc_id) where n_chars is not null and quality is not null and toxic is not null), n as (select source, x, y, count(*) as c from r group by all), {plan_sql(98, 'n')},
    w as (select draw, x, y, sum(c.m * 0 + n.c * weight) as w from plan join c using (k) join n using (source) group by all union all select -1, x, y, sum(c) from n group by all),
    a as (select draw, x, {_MIDRANK.format('x')} as a from (select draw, x, sum(w) as w from w group by all)), b as (select draw, y, {_MIDRANK.format('y')} as b from (select draw, y, sum(w) as w from w group by all)),
    s as (select draw, sum(w) as n, round({_RHO}, 9) as rho from w join a using (draw, x) join b using (draw, y) group by draw)
    select max(rho) filter (draw = -1) as rho, max(n) filter (draw = -1)::bigint as rows, round(quantile_cont(rho, 0.025) filter (draw >= 0), 7) as ci_low, round(quantile_cont(rho, 0.975) filter (draw >= 0), 7) as ci_high, count(rho) filter (draw >= 0) as finite_draws, (select count(*) from c) as clusters from s""")
def spearman(t: Tables) -> DataFrame:
    """Rank correlation of length and label of documents, sources drawn; ranks are remade in each draw from counts."""
    rows = t.documents.select("doc_id", "source", F.floor(F.col("n_chars") / 400).alias("x")).join(t.labels.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("y")), "doc_id")
    return C.rank_correlation_bootstrap(rows.select("source", "x", "y"), "source", DRAWS, 98)


# A mixed model of the panel -------------------------------------------------------------------------------------------------------

#: Terms that only the full model has.
INTERACTIONS = [f"model:{b[1:]}" for b in BUDGETS[1:]]


def panel_terms() -> dict[str, Column]:
    """Model by budget, and what a render is drawn in; the languages but one stand for components."""
    special = F.col("model") == "SPECIALIZED"
    budgets = {b[1:]: F.col("budget") == b for b in BUDGETS[1:]}
    render = F.col("render")
    others = {"font": render % 2 == 1, "size": F.floor(render / 2) % 2 == 1, "member": render >= 4} | {f"lang_{v}": F.col("lang") == v for v in ("de", "es", "fr")}
    return {"one": F.lit(True), "model": special} | budgets | {n: special & b for n, b in zip(INTERACTIONS, budgets.values(), strict=True)} | others


@query("GLM1_DEC6_mixed_logit")
def mixed_logit(t: Tables) -> DataFrame:
    """Logistic regression of the panel with intercepts of sources and of members in sources: terms, errors, and the test of model by
    budget. Fits that fail a check are said to, and the bootstrap family takes their place."""
    rows = panel(t).withColumn("member", F.col("render") >= 4)
    full, null, statistic, df, p = M.likelihood_ratio(rows, "source", "member", panel_terms(), INTERACTIONS, F.col("ok"))
    passed = full.passed and null.passed
    route = rules.uses_fallback({"fit_status": rules.FITTED if passed else rules.MISFIT, "diagnostics_available": True, "diagnostics_pass": passed})
    faults = ",".join(sorted({n for f in (full, null) for n, ok in f.checks.items() if not ok}))
    out = [(n, float(e), float(s), statistic, df, p, faults, route) for n, e, s in zip(full.terms, full.estimates, full.errors, strict=True)]
    return t.spark.createDataFrame(out, "term string, estimate double, error double, lr_statistic double, df int, p double, failed_checks string, uses_fallback boolean")
