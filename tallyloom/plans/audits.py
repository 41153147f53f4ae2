"""Checks of texts and designs, in relations; and residual covariance after main effects. Whole tables; SQL written from the rules.

Texts are those of conversations in Thai letters (plans/rereads.py), so that they bear marks. Words are their distinct ones.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import markup as M
from tallyloom.functions import text as X
from tallyloom.operators import resample as B
from tallyloom.operators.storage import new_path
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.rereads import LATIN, THAI, thai
from tallyloom.sources import shards as H

# Vowels that are above and below, tone marks, the tone mark that pairs differ by, and rules of difference.
UPPER, LOWER, TONES, EK = "ิ-ื", "ุู", "่-๋", "่"
RULES = ("BASE_SUBSTITUTION", "MAI_EK_ADDITION", "UPPER_VOWEL_SUBSTITUTION", "LOWER_VOWEL_SUBSTITUTION", "MAI_EK_IN_UPPER_CONTEXT")
COMPONENTS = ("BASE_CHARACTER", "TONE_MARK", "UPPER_VOWEL_VARIANT", "LOWER_VOWEL_VARIANT", "STACKED_TONE_MARK")

_WORDS = f"words as (select distinct unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{THAI}'), '[^ \\t-\\r]+')) as a from conversations)"
_PAIRS = f"""{_WORDS}, pairs as (select a, case length(a) % 5 when 0 then 'ก' || substr(a, 2) when 2 then replace(a, 'ิ', 'ี') when 3 then replace(a, 'ุ', 'ู') else substr(a, 1, 1) || '{EK}' || substr(a, 2) end as b, length(a) % 5 as k from words)"""


def words(t: Tables) -> DataFrame:
    return t.conversations.select(F.explode(F.regexp_extract_all(thai(F.col("text")), F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("a")).distinct()


def word_pairs(t: Tables) -> DataFrame:
    """a, b, k: each word and what its rule makes of it."""
    a, k = F.col("a"), F.length("a") % 5
    marked = F.concat(F.left(a, F.lit(1)), F.lit(EK), F.substr(a, F.lit(2)))
    b = F.when(k == 0, F.concat(F.lit("ก"), F.substr(a, F.lit(2)))).when(k == 2, F.replace(a, F.lit("ิ"), F.lit("ี"))).when(k == 3, F.replace(a, F.lit("ุ"), F.lit("ู"))).otherwise(marked)
    return words(t).select("a", b.alias("b"), k.alias("k"))


def marks_in_order(text: Column) -> Column:
    """No vowel above or below follows a tone mark before the next consonant."""
    return ~F.regexp_replace(text, f"[^ก-ฮ{UPPER}{LOWER}{TONES}]", "").rlike(f"[{TONES}][{UPPER}{LOWER}]")


def _in_order(text: str) -> str:
    return f"not regexp_matches(regexp_replace({text}, '[^ก-ฮ{UPPER}{LOWER}{TONES}]', '', 'g'), '[{TONES}][{UPPER}{LOWER}]')"


def pair_issues(a: Column, b: Column, rule: Column, nfc_a: Column, nfc_b: Column) -> Column:
    """Sorted names of what is wrong with a minimal pair under its rule of difference."""
    same_length = F.length(a) == F.length(b)
    unlike = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    both = lambda members: F.substr(a, F.get(unlike, 0), F.lit(1)).rlike(f"[{members}]") & F.substr(b, F.get(unlike, 0), F.lit(1)).rlike(f"[{members}]")
    added = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b))), lambda i: (F.substr(b, i, F.lit(1)) == EK) & (F.concat(F.substr(b, F.lit(1), i - 1), F.substr(b, i + 1)) == a))
    one = same_length & (F.size(unlike) == 1)
    fits = (
        F.when(rule == RULES[0], same_length & (F.substr(a, F.lit(2)) == F.substr(b, F.lit(2))) & a.rlike("^[ก-ฮ]") & b.rlike("^[ก-ฮ]") & (F.left(a, F.lit(1)) != F.left(b, F.lit(1))))
        .when(rule == RULES[1], added).when(rule == RULES[2], one & both(UPPER)).when(rule == RULES[3], one & both(LOWER)).when(rule == RULES[4], added & a.rlike(f"[{UPPER}]"))
    )
    found = [F.when((a == "") | (b == ""), "EMPTY_STRING"), F.when(a == b, "IDENTICAL_STRINGS"), F.when(~rule.isin(*RULES), "UNKNOWN_DIFFERENCE_RULE")]
    found.append(F.when(rule.isin(*RULES) & ~F.coalesce(fits, F.lit(False)), "DIFFERENCE_RULE_MISMATCH"))
    for side, text, nfc in (("A", a, nfc_a), ("B", b, nfc_b)):
        found += [F.when(text.rlike("[^฀-๿]"), f"NON_THAI_CODEPOINT_{side}"), F.when(~nfc, f"NON_NFC_{side}"), F.when(~marks_in_order(text), f"NONCANONICAL_MARK_ORDER_{side}")]
    return F.array_sort(F.array_compact(F.array(*found)))


_ONE = "length(a) = length(b) and len(u) = 1"
_ADDED = f"len(list_filter(range(1, length(b) + 1), lambda i: substr(b, i, 1) = '{EK}' and substr(b, 1, i - 1) || substr(b, i + 1) = a)) > 0"


@query("TXT17_TXT18_minimal_pairs", f"""with {_PAIRS}, u as (select *, list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) as u from pairs), f as (select *, coalesce(case k
      when 0 then length(a) = length(b) and substr(a, 2) = substr(b, 2) and regexp_matches(a, '^[ก-ฮ]') and regexp_matches(b, '^[ก-ฮ]') and substr(a, 1, 1) <> substr(b, 1, 1)
      when 1 then {_ADDED} when 2 then {_ONE} and regexp_matches(substr(a, u[1], 1), '[{UPPER}]') and regexp_matches(substr(b, u[1], 1), '[{UPPER}]')
      when 3 then {_ONE} and regexp_matches(substr(a, u[1], 1), '[{LOWER}]') and regexp_matches(substr(b, u[1], 1), '[{LOWER}]') else {_ADDED} and regexp_matches(a, '[{UPPER}]') end, false) as fits from u)
    select a, b, {_in_order('a')} as a_in_order, array_to_string(list_sort(list_filter([case when a = b then 'IDENTICAL_STRINGS' end, case when not fits then 'DIFFERENCE_RULE_MISMATCH' end, case when regexp_matches(a, '[^฀-๿]') then 'NON_THAI_CODEPOINT_A' end,
      case when regexp_matches(b, '[^฀-๿]') then 'NON_THAI_CODEPOINT_B' end, case when nfc_normalize(a) <> a then 'NON_NFC_A' end, case when nfc_normalize(b) <> b then 'NON_NFC_B' end,
      case when not {_in_order('a')} then 'NONCANONICAL_MARK_ORDER_A' end, case when not {_in_order('b')} then 'NONCANONICAL_MARK_ORDER_B' end], lambda x: x is not null)), ',') as issues from f""")
def minimal_pairs(t: Tables) -> DataFrame:
    """Each word and its variant: what is wrong with them as a pair that differs by the rule."""
    a, b = F.col("a"), F.col("b")
    rule = F.element_at(F.array(*map(F.lit, RULES)), F.col("k") + 1)
    nfc = M.is_composed_udf()
    p = word_pairs(t).select("a", "b", rule.alias("rule"), nfc(a).alias("na"), nfc(b).alias("nb"))
    return p.select("a", "b", marks_in_order(a).alias("a_in_order"), F.array_join(pair_issues(a, b, F.col("rule"), F.col("na"), F.col("nb")), ",").alias("issues"))


def taxonomy(output: Column, target: Column, opposite: Column) -> Column:
    """What an answer in one line is; the first that fits."""
    return (
        F.when(output.contains("\n"), "output_contract_failure").when(output == "", "deletion").when(output == target, "correct_target")
        .when(output == opposite, "opposite_member_substitution").otherwise("other_substitution")
    )


def component_correct(output: Column, truth: Column, component: Column) -> Column:
    """Whether the component that a pair differs by is right, whatever else the output has."""
    base = lambda c: F.regexp_extract(c, "[ก-ฮ]", 0)
    tone = output.contains(EK) == truth.contains(EK)
    variant = lambda x, y: F.when(truth.contains(x), output.contains(x) & ~output.contains(y)).otherwise(output.contains(y) & ~output.contains(x))
    upper = F.regexp_extract(truth, "[ิ-ื็]", 0)
    return (
        F.when(component == COMPONENTS[0], (base(output) != "") & (base(output) == base(truth))).when(component == COMPONENTS[1], tone)
        .when(component == COMPONENTS[2], variant("ิ", "ี")).when(component == COMPONENTS[3], variant("ุ", "ู"))
        .when(component == COMPONENTS[4], (upper != "") & output.contains(upper) & tone).otherwise(F.raise_error(F.lit("unknown component")))
    )


_VARIANT = "case when contains(a, '{x}') then contains(o, '{x}') and not contains(o, '{y}') else contains(o, '{y}') and not contains(o, '{x}') end"


@query("TXT35_TXT36_pilot_answers", f"""with {_PAIRS}, raw as (select *, case length(a) % 7 when 0 then ' ' || a || chr(13) || chr(10) when 1 then b when 2 then ' ' when 3 then a || chr(10) || b else substr(a, 1, length(a) - 1) end as raw from pairs),
    o as (select *, regexp_replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') as o from raw)
    select a, o as answer, case when contains(o, chr(10)) then 'output_contract_failure' when o = '' then 'deletion' when o = a then 'correct_target' when o = b then 'opposite_member_substitution' else 'other_substitution' end as taxonomy,
    case k when 0 then regexp_extract(o, '[ก-ฮ]') <> '' and regexp_extract(o, '[ก-ฮ]') = regexp_extract(a, '[ก-ฮ]') when 1 then contains(o, '{EK}') = contains(a, '{EK}') when 2 then {_VARIANT.format(x='ิ', y='ี')} when 3 then {_VARIANT.format(x='ุ', y='ู')}
    else regexp_extract(a, '[ิ-ื็]') <> '' and contains(o, regexp_extract(a, '[ิ-ื็]')) and contains(o, '{EK}') = contains(a, '{EK}') end as component_correct from o""")
def pilot(t: Tables) -> DataFrame:
    """Answers to words by what they are, and whether the component at stake is right."""
    a, b, n = F.col("a"), F.col("b"), F.length("a") % 7
    raw = F.when(n == 0, F.concat(F.lit(" "), a, F.lit("\r\n"))).when(n == 1, b).when(n == 2, " ").when(n == 3, F.concat(a, F.lit("\n"), b)).otherwise(F.left(a, F.length(a) - 1))
    p = word_pairs(t).withColumn("o", X.strip_space(X.newlines(raw)))
    component = F.element_at(F.array(*map(F.lit, COMPONENTS)), F.col("k") + 1)
    return p.select("a", F.col("o").alias("answer"), taxonomy(F.col("o"), a, b).alias("taxonomy"), component_correct(F.col("o"), a, component).alias("component_correct"))


@query("AGG60_thai_token_shares", f"""with w as (select role, unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{THAI}'), '[^ \\t-\\r]+')) as w from conversations), k as (select role, case when regexp_matches(w, '[่-๋ัิ-ื็ุู]') then 'm' when regexp_matches(w, '[฀-๿]') then 'n' else 'o' end as kind from w)
    select role, count(*) filter (kind = 'm') as has_thai_mark, count(*) filter (kind = 'n') as thai_no_mark, count(*) filter (kind = 'o') as other, round(count(*) filter (kind = 'm') / nullif(count(*) filter (kind <> 'o'), 0), 9) as mark_share_thai from k group by role""")
def thai_shares(t: Tables) -> DataFrame:
    """Words of each role with marks, in Thai without any, and others; marked ones among the Thai ones."""
    w = t.conversations.select("role", F.explode(F.regexp_extract_all(thai(F.col("text")), F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("w"))
    kind = F.when(F.col("w").rlike("[่-๋ัิ-ื็ุู]"), "m").when(X.has_thai(F.col("w")), "n").otherwise("o")
    n = {k: F.count_if(kind == k) for k in "mno"}
    return w.groupBy("role").agg(n["m"].alias("has_thai_mark"), n["n"].alias("thai_no_mark"), n["o"].alias("other"), F.round(F.try_divide(n["m"], n["m"] + n["n"]), 9).alias("mark_share_thai"))


@query("CMP27_pair_rates_of_eight", "select s_suppkey, model, count(*) filter (right_) as successes, round(avg(right_::int), 9) as rate from (select s_suppkey, model, ('0x' || substr(sha256('6:' || s_suppkey || ':' || model || ':' || render), 1, 2))::bigint % 4 > 0 as right_ from supplier, (select unnest(['BASE', 'SPECIALIZED']) as model), (select unnest(range(8)) as render)) group by all")
def pair_rates(t: Tables) -> DataFrame:
    """Successes of each pair and model, over eight renders; any other number of them is refused."""
    models, renders = F.array(F.lit("BASE"), F.lit("SPECIALIZED")), F.sequence(F.lit(0), F.lit(7))
    rows = t.supplier.select("s_suppkey", F.explode(models).alias("model")).select("s_suppkey", "model", F.explode(renders).alias("render"))
    right = X.digest_number(X.digest(6, F.col("s_suppkey"), F.col("model"), F.col("render")), 2) % 4 > 0
    rates = rows.groupBy("s_suppkey", "model").agg(F.count_if(right).alias("successes"), F.round(F.avg(right.cast("int")), 9).alias("rate"), F.count("*").alias("n"))
    return rates.where(F.assert_true(F.col("n") == 8, F.lit("a pair has other than eight rows")).isNull()).drop("n")


@query("CMP18_blank_preferences", """with c as (select s_suppkey, o, case when (('0x' || substr(sha256('2:' || s_suppkey || ':' || o), 1, 2))::bigint % 2 = 0) = (o = 'AB') then 'a' else 'b' end as member from supplier, (select unnest(['AB', 'BA']) as o))
    select s_suppkey, count(*) filter (member = 'a') as a_count, count(*) filter (member = 'b') as b_count, case when a_count > b_count then 'a' when b_count > a_count then 'b' else 'TIE' end as preference from c group by 1""")
def blank_preferences(t: Tables) -> DataFrame:
    """The member that each pair's blanks prefer over both orders; two blanks of one order are refused."""
    blanks = t.supplier.select("s_suppkey", F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("o"))
    choice = F.when(X.digest_number(X.digest(2, F.col("s_suppkey"), F.col("o")), 2) % 2 == 0, "A").otherwise("B")
    n = lambda m: F.count_if(F.col("member") == m)
    c = blanks.withColumn("member", X.canonical_member(choice, F.col("o"))).groupBy("s_suppkey").agg(n("a").alias("a_count"), n("b").alias("b_count"), F.count("*").alias("n"), F.count_distinct("o").alias("orders"))
    c = c.where(F.assert_true(F.col("n") == F.col("orders"), F.lit("two blanks of one order")).isNull())
    preference = F.when(F.col("a_count") > F.col("b_count"), "a").when(F.col("b_count") > F.col("a_count"), "b").otherwise("TIE")
    return c.select("s_suppkey", "a_count", "b_count", preference.alias("preference"))


@query("AGG43_all_subsets_curve", """with f as (select distinct user_id, event_type from events where value > 80), types as (select list(distinct event_type order by event_type) as e from events), sets as (select list_filter(e, lambda x, i: (m >> (i - 1)::int) & 1 = 1) as s from types, (select unnest(range(1, (1 << (select len(e) from types))::bigint)) as m)),
    users as (select user_id, list(event_type) filter (value > 80) as h from events group by 1), hit as (select s, avg(coalesce(list_has_any(h, s), false)::int) as v from users, sets group by s) select len(s)::int as k, round(avg(v), 9) as share, count(*) as subsets from hit group by 1""")
def curve(t: Tables) -> DataFrame:
    """Share found by k reads, over all subsets of k reads: of m reads, h of which found an item, all but C(m - h, k) of C(m, k) subsets do."""
    found = t.events.groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 80).alias("found"))
    m = found.select("event_type").distinct().count()  # reads of the study: a handful
    hits = found.groupBy("user_id").agg(F.count_if("found").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(k).alias("k"), F.element_at(F.array(*(F.lit(1 - comb(m - h, k) / comb(m, k)) for h in range(m + 1))), F.col("h").cast("int") + 1).alias("share"), F.lit(comb(m, k)).cast("long").alias("subsets")) for k in range(1, m + 1)]
    each = hits.select("n", F.explode(F.array(*rows)).alias("r")).select("n", "r.*")
    return each.groupBy("k", "subsets").agg(F.round(F.sum(F.col("share") * F.col("n")) / F.sum("n"), 9).alias("share")).select("k", "share", "subsets")


_SPLIT = "('0x' || substr(sha256('13:' || p_partkey), 1, 2))::bigint"


@query("WRK8_CMP40_locked_audit", f"""with c as (select p_brand, count(*) as n, count(*) filter ({_SPLIT} % 4 = 0) as l from part where {_SPLIT} % 8 <> 1 group by 1)
    select sum(n)::bigint as selected_pairs, sum(l)::bigint as locked_pairs, count(*) as components, min(n) as fewest, max(n) as most, sum(l) = 0 and min(n) = 19 and max(n) = 19 as valid from c""")
def locked_audit(t: Tables) -> DataFrame:
    """Pairs selected, those among them that are locked, and pairs by component; valid with none locked and 19 of each."""
    h = X.digest_number(X.digest(13, F.col("p_partkey")), 2)
    chosen = t.part.select("p_brand", (h % 4 == 0).alias("locked")).where(h % 8 != 1).groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("locked").alias("l"))
    valid = (F.sum("l") == 0) & (F.min("n") == 19) & (F.max("n") == 19)
    return chosen.agg(F.sum("n").alias("selected_pairs"), F.sum("l").alias("locked_pairs"), F.count("*").alias("components"), F.min("n").alias("fewest"), F.max("n").alias("most"), valid.alias("valid"))


@query("INT3_content_manifest", """with f as (select page_id, regexp_replace(url, '^https?://', '') as path, html from pages) select page_id, path, strlen(html) as bytes, sha256(html) as sha256, contains(path, chr(92)) or path = '' or path like '/%' or path <> nfc_normalize(path) or regexp_matches(rtrim(path, '/'), '(^|/)(\\.{0,2})(/|$)') or regexp_matches(path, '^[^/]*:(/|$)') as unsafe, count(*) over (partition by path) > 1 as duplicate, count(*) over (partition by lower(path)) > 1 as collides from f""")
def manifest(t: Tables) -> DataFrame:
    """Path, size and digest of each page, and whether its path is unsafe or there twice, in whatever case."""
    path = F.col("path")
    f = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    unsafe = path.contains("\\") | (path == "") | path.startswith("/") | ~M.is_composed_udf()(path) | F.rtrim(path, F.lit("/")).rlike(r"(^|/)(\.{0,2})(/|$)") | path.rlike("^[^/]*:(/|$)")
    n = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    return f.select("page_id", "path", "bytes", "sha256", unsafe.alias("unsafe"), n(path).alias("duplicate"), n(F.lower(path)).alias("collides"))


@query("SRT1_SRT2_shard_then_limit", "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by source, doc_id) - 1 as k from documents) where k % 3 = 1 and k // 3 < 20")
def shard_then_limit(t: Tables) -> DataFrame:
    """The first 20 of the second of three shards of each language, dealt in order of source and id."""
    k = F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id")) - 1
    return t.documents.select("doc_id", "lang", k.alias("k")).where((F.col("k") % 3 == 1) & (F.floor(F.col("k") / 3) < 20)).select("doc_id", "lang")


@query("FLT10_available_development_rows", f"""select conv_id, turn from conversations where ('0x' || substr(sha256('17:' || conv_id), 1, 2))::bigint % 4 = 0 and regexp_matches(translate(lower(text), '{LATIN}', '{THAI}'), '[฀-๿]') and conv_id in (select page_id from pages)""")
def available(t: Tables) -> DataFrame:
    """Rows of the development split that hold Thai and whose page is there."""
    dev = X.digest_number(X.digest(17, F.col("conv_id")), 2) % 4 == 0
    rows = t.conversations.where(dev & X.has_thai(thai(F.col("text")))).select("conv_id", "turn")
    return rows.join(t.pages.select(F.col("page_id").alias("conv_id")), "conv_id", "left_semi")


@query("WRK9_units_in_queues", """with q as (select o_custkey as unit, count(distinct o_orderpriority) as n from orders group by 1), u as (select c_custkey as unit from customer)
    select *, missing = 0 and unknown = 0 and repeated = 0 as valid from (select (select count(*) from u) as units, (select count(*) from u where unit not in (select unit from q)) as missing, (select count(*) from q where unit not in (select unit from u)) as unknown, (select count(*) from q where n > 1) as repeated)""")
def units(t: Tables) -> DataFrame:
    """Units that are in no queue, that are in one without being known, and that are in several; valid if there are none."""
    queued = t.orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count_distinct("o_orderpriority").alias("n"))
    both = t.customer.select(F.col("c_custkey").alias("unit"), F.lit(True).alias("known")).join(queued, "unit", "full")
    n = both.agg(F.count("known").alias("units"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return n.withColumn("valid", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))


#: Cells of factors that main effects are fitted on; their sums go to the driver.
MOST_CELLS = 100_000
#: Draws of pairs.
DRAWS = 10_000


def main_effects(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Adds residual: the value less what least squares on one dummy a level, but the first of each factor, fits.

    Cells of the factors hold all that is needed: their numbers and sums. Null levels are levels.
    """
    cells = rows.groupBy(*factors).agg(F.count(value).alias("n"), F.sum(value).alias("s")).where("n > 0").limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"factors have more than {MOST_CELLS} cells")
    columns = [np.ones(len(cells))] + [np.array([c[f] == level for c in cells], float) for f in factors for level in sorted({c[f] for c in cells}, key=str)[1:]]
    design, n, s = np.column_stack(columns), np.array([c.n for c in cells], float), np.array([c.s for c in cells], float)
    root = np.sqrt(n)
    fitted = design @ np.linalg.lstsq(design * root[:, None], s / np.maximum(root, 1), rcond=None)[0] if cells else []
    schema = ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in factors) + ", _fit double"
    fits = rows.sparkSession.createDataFrame([(*(c[f] for f in factors), float(v)) for c, v in zip(cells, fitted, strict=True)], schema)
    on = [rows[f].eqNullSafe(fits[f]) for f in factors]
    return rows.join(F.broadcast(fits), on, "left").select(*(rows[c] for c in rows.columns), (F.col(value) - F.col("_fit")).alias("residual"))


@query("GLM2_AGG62_BOO22_residual_covariance")
def covariance(t: Tables) -> DataFrame:
    """Covariance of orders of one nation and member, and of its two members, beside main effects; nations drawn.

    Within: the mean product of two different residuals of a target; cross: of one of each member; excess: what within is more.
    """
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 2).alias("member"), F.log("o_totalprice").alias("y"))
    r = main_effects(o, ["o_orderpriority", "o_orderstatus", "year", "member"], "y").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("pair")), "o_custkey")
    moments = r.groupBy("pair", "member").agg(F.count("residual").alias("n"), F.sum("residual").alias("s"), F.sum(F.col("residual") ** 2).alias("q"))
    product = (F.col("s") ** 2 - F.col("q")) / (F.col("n") * (F.col("n") - 1))
    side = lambda m, v: F.max(F.when(F.col("member") == m, v))
    pairs = moments.where("n > 1").groupBy("pair").agg(((side(0, product) + side(1, product)) / 2).alias("within"), (side(0, F.col("s") / F.col("n")) * side(1, F.col("s") / F.col("n"))).alias("cross"))
    clusters = B.cluster_sums(pairs.where("within is not null and cross is not null"), "pair", [], {"within": F.col("within"), "cross": F.col("cross"), "one": F.lit(1)})
    mean = lambda c: F.col(c) / F.col("one")
    point = clusters.agg(*(F.sum(c).alias(c) for c in ("within", "cross", "one")))
    excess = B.draw_sums(clusters, B.plan(clusters, [], DRAWS, 53), [], ["within", "cross", "one"]).select((mean("within") - mean("cross")).alias("v"))
    ends = excess.agg(*(F.round(F.percentile("v", q), 9).alias(n) for n, q in (("ci_low", 0.025), ("median", 0.5), ("ci_high", 0.975))), F.round(F.avg((F.col("v") <= 0).cast("int")), 9).alias("not_above_zero"))
    return point.select(F.col("one").alias("pairs"), *(F.round(v, 9).alias(n) for n, v in (("within", mean("within")), ("cross", mean("cross")), ("excess", mean("within") - mean("cross"))))).join(ends, how="cross")


@query("SRC1_SRC2_SRC4_SNK1_SNK6_INT2_shard_table", """select lang, count(*) as documents, sum(n_chars)::bigint as chars, sum(('0x' || substr(sha256(text), 1, 8))::bigint)::bigint as digests from documents where text is not null group by lang""")
def shard_table(t: Tables) -> DataFrame:
    """Documents written as shards of JSON lines with their checksums, in two writes of which the second repeats the first, and read back strictly."""
    docs = t.documents.where("text is not null").select("doc_id", "lang", "n_chars", "text")
    path = new_path(t.spark)
    H.append_missing(docs.where("doc_id % 3 > 0"), path, ["doc_id"])
    H.append_missing(docs, path, ["doc_id"])
    back = H.read_table(t.spark, path, docs.schema, ["doc_id"])
    return back.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.sum(X.digest_number(F.sha2("text", 256))).alias("digests"))
