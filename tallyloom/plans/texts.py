"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.plans import observations as O
from tallyloom.plans.registry import Tables, query

_THAI = "'ไฟฟ้า น้ำ ก' || (doc_id % 7)::varchar || 'กี่ปู่'"


@query("TXT1_normalize_markup", r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<figure>.*?</figure>', ' ', 'g'), '(?is)<page_number>(.*?)</page_number>', ' \1 ', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), '(?m)^\s{0,3}#{1,6}\s*', '', 'g'),
    '**', ''), '__', ''), '`', ''), '$', ''), '|', ' '), '\s+', ' ', 'g')) as text from pages""")
def normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normalize_markup(F.col("html")).alias("text"))


@query("TXT2_collapse_whitespace", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapse_whitespace(F.col("text")).alias("text"))


@query("TXT6_strip_tags", r"select page_id, regexp_replace(regexp_replace(html, '<[^<>]*$', ''), '</?[a-zA-Z][^>]*>', ' ', 'g') as text from pages")
def tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.strip_tags(X.cut_partial_tag(F.col("html"))).alias("text"))


@query("TXT8_is_wrapped", r"""select conv_id, turn, regexp_matches(case when turn % 2 = 0 then '{"natural_text": "' || text || '"}' else text end, '^\s*\{\s*"natural_text"\s*:') as wrapped from conversations""")
def wrapped(t: Tables) -> DataFrame:
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"natural_text": "'), "text", F.lit('"}'))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.is_wrapped(raw).alias("wrapped"))


@query("TXT9_close_figure", r"""select page_id, case when len(regexp_extract_all(h, '(?i)<figure\b')) > len(regexp_extract_all(h, '(?i)</figure>')) then h || '</figure>' else h end as html
    from (select page_id, case when page_id % 2 = 0 then html || '<figure>open' else html end as h from pages)""")
def figures(t: Tables) -> DataFrame:
    raw = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<figure>open"))).otherwise(F.col("html"))
    return t.pages.select("page_id", X.close_figure(raw).alias("html"))


@query("TXT10_TXT11_newlines_and_strip", r"""select doc_id, regexp_replace(regexp_replace(' ' || text || chr(13) || chr(10), '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents""")
def newline(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.newlines(F.concat(F.lit(" "), "text", F.lit("\r\n"))).alias("text"))


@query("TXT12_TXT13_choices", r"""with r as (select doc_id, case doc_id % 5 when 0 then ' a' || chr(10) when 1 then 'B' when 2 then 'b) yes' when 3 then 'AB' else substr(text, 1, 5) end as raw from documents)
    select doc_id, case when regexp_matches(upper(trim(raw, ' ' || chr(10))), '^[AB]$') then upper(trim(raw, ' ' || chr(10))) end as choice,
    case when regexp_matches(upper(trim(raw, ' ' || chr(10))), '^[AB]$') then 'PARSED' else 'PARSER_FAILURE' end as status,
    nullif(upper(regexp_extract(raw, '^\s*\(?([A-Ba-b])(?:[\s).:,]|$)', 1)), '') as label from r""")
def choices(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " a\n").when(k == 1, "B").when(k == 2, "b) yes").when(k == 3, "AB").otherwise(F.substring("text", 1, 5))
    r = t.documents.select("doc_id", raw.alias("raw"))
    return r.select("doc_id", X.parse_choice(F.col("raw")).alias("choice"), X.parse_status(F.col("raw")).alias("status"), X.leading_label(F.col("raw")).alias("label"))


@query("TXT14_thai", f"select doc_id, regexp_matches(t, '[\\x{{0E00}}-\\x{{0E7F}}]') as has_thai, len(regexp_extract_all(t, '[\\x{{0E00}}-\\x{{0E7F}}]')) as thai from (select doc_id, case when doc_id % 2 = 0 then {_THAI} else text end as t from documents)")
def thai(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, _thai()).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.has_thai(raw).alias("has_thai"), X.thai_count(raw).alias("thai"))


def _thai():
    return F.concat(F.lit("ไฟฟ้า น้ำ ก"), (F.col("doc_id") % 7).cast("string"), F.lit("กี่ปู่"))


@query("TXT16_codepoints", f"select doc_id, array_to_string(list_transform(string_split({_THAI}, ''), lambda c: 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0')), ' ') as points from documents")
def points(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.codepoints(_thai()), " ").alias("points"))


@query("TXT19_component_classes", f"""with c as (select unnest(string_split({_THAI}, '')) as c from documents)
    select case when c in ('่', '้', '๊', '๋') then 'TONE' when c in ('ั', 'ิ', 'ี', 'ึ', 'ื', '็') then 'UPPER' when c in ('ุ', 'ู') then 'LOWER' when unicode(c) between 3585 and 3630 then 'CONSONANT' else 'OTHER' end as component, count(*) as n from c group by 1""")
def classes(t: Tables) -> DataFrame:
    chars = t.documents.select(F.explode(X.characters(_thai())).alias("c"))
    return chars.groupBy(X.component(F.col("c")).alias("component")).agg(F.count("*").alias("n"))


@query("TXT20_clusters")
def clusters(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.clusters(_thai()), "/").alias("clusters"))


@query("TXT23_mark_sites")
def sites(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.explode(X.mark_sites(_thai())).alias("s"))
    return s.select("doc_id", "s.kind", "s.index", "s.reference")


@query("TXT24_TXT25_variants")
def variants(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", _thai().alias("text")).withColumn("s", F.explode(X.mark_sites(F.col("text")))).where("s.kind = 'TONE'")
    v = s.withColumn("label", F.explode(F.array(*map(F.lit, (X.NONE, *X.TONE_MARKS)))))
    whole = X.apply_variant(F.col("text"), F.col("s.kind"), F.col("s.index"), F.col("label"))
    end = F.least(F.length("text"), F.col("s.index") + 9) + F.length(whole) - F.length("text")
    return v.select("doc_id", F.col("s.index").alias("index"), "label", F.substr(whole, F.lit(1), end).alias("window"))


@query("TXT29_parse_box", r"""select doc_id, regexp_extract(q, '\[\s*(-?\d+(?:\.\d+)?)\s*,', 1)::double as x0, regexp_extract(q, ',\s*(-?\d+(?:\.\d+)?)\s*\]', 1)::double as y1
    from (select doc_id, 'Read [' || doc_id || ', 2.5, ' || n_chars || '.25, -4] now' as q from documents)""")
def box(t: Tables) -> DataFrame:
    q = F.concat(F.lit("Read ["), F.col("doc_id").cast("string"), F.lit(", 2.5, "), F.col("n_chars").cast("string"), F.lit(".25, -4] now"))
    return t.documents.select("doc_id", X.parse_box(q).alias("b")).select("doc_id", "b.x0", "b.y1")


@query("TXT30_AGG28_markup_audit", r"""select page_id, len(regexp_extract_all(html, '</?[a-zA-Z][^>]*>')) as tags, len(regexp_extract_all(html, '(?m)^\s{0,3}#{1,6}\s')) as headings, len(regexp_extract_all(html, '(?i)<li\b')) as items,
    len(regexp_extract_all(html, '(?i)<(?:b|strong)\b')) as bold, len(regexp_extract_all(html, '&[a-zA-Z]+;')) as entities, length(html) as characters from pages""")
def audit(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select(
        "page_id", n("</?[a-zA-Z][^>]*>").alias("tags"), n(r"(?m)^\s{0,3}#{1,6}\s").alias("headings"), n(r"(?i)<li\b").alias("items"),
        n(r"(?i)<(?:b|strong)\b").alias("bold"), n("&[a-zA-Z]+;").alias("entities"), F.length("html").cast("long").alias("characters"),
    )


@query("SRT3_top_tags", r"""select tag, count(*) as n from (select lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) as tag from pages) group by tag order by n desc, tag limit 8""")
def top_tags(t: Tables) -> DataFrame:
    tag = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag")
    return t.pages.select(tag).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(8)


@query("TXT31_collapse_digits", "select doc_id, regexp_replace(text, '[0-9๐-๙]+', '0', 'g') as text from documents")
def digits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapse_digits(F.col("text")).alias("text"))


@query("TXT32_SMP8_length_ratio", f"with {O.PAIRS_SQL} select doc_id, round(length(hypothesis) / greatest(1, length(reference)), 9) as ratio, length(hypothesis) > 1.5 * length(reference) as over from pairs")
def ratio(t: Tables) -> DataFrame:
    p = O.pairs(t.documents)
    return p.select("doc_id", F.round(X.length_ratio(F.col("hypothesis"), F.col("reference")), 9).alias("ratio"), (F.length("hypothesis") > 1.5 * F.length("reference")).alias("over"))


@query("TXT33_TXT34_output_categories", r"""with r as (select doc_id, case doc_id % 6 when 0 then 'กี่' when 1 then 'กี้' when 2 then '' when 3 then 'ก ข' when 4 then 'ขข' else 'x' || chr(65533) end as raw from documents)
    select doc_id, case when raw = 'กี่' then 'EXACT_TARGET' when raw = 'กี้' then 'OPPOSITE_MEMBER' when raw = '' then 'EMPTY' when regexp_matches(raw, '\s') then 'WHITESPACE' when raw = 'ขข' then 'OTHER_THAI' else 'NON_THAI' end as category,
    case when contains(raw, chr(65533)) then 'REPLACEMENT_CHARACTER' when regexp_matches(raw, '\s') then 'INTERNAL_WHITESPACE' end as failure from r""")
def categories(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, "กี่").when(k == 1, "กี้").when(k == 2, "").when(k == 3, "ก ข").when(k == 4, "ขข").otherwise("x�")
    return t.documents.select("doc_id", raw.alias("raw")).select("doc_id", X.classify_output(F.col("raw"), F.lit("กี่"), F.lit("กี้")).alias("category"), X.decoded_contract(F.col("raw")).alias("failure"))


@query("TXT37_TXT38_canonical_member", """select doc_id, case when choice = 'A' then (case when straight then 'a' else 'b' end) when choice = 'B' then (case when straight then 'b' else 'a' end) end as member
    from (select doc_id, case doc_id % 3 when 0 then 'A' when 1 then 'B' end as choice, doc_id % 2 = 0 as straight from documents)""")
def member(t: Tables) -> DataFrame:
    choice = F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B")
    return t.documents.select("doc_id", X.canonical_member(choice, F.when(F.col("doc_id") % 2 == 0, "AB").otherwise("BA")).alias("member"))


@query("TXT39_slug", r"select page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) as slug from pages")
def slugs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.slug(F.col("url")).alias("slug"))


@query("TXT40_TXT43_digests", """select doc_id, h as digest, ('0x' || substr(h, 1, 8))::bigint as seed, ('0x' || substr(h, 1, 2))::bigint % 2 as parity, substr(sha256(doc_id || '|' || source), 1, 16) as call_id
    from (select doc_id, source, sha256('20260101:' || doc_id) as h from documents)""")
def digests(t: Tables) -> DataFrame:
    h = X.digest(20260101, F.col("doc_id"))
    call = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source"), 256), 1, 16)
    return t.documents.select("doc_id", h.alias("digest"), X.digest_number(h).alias("seed"), (X.digest_number(h, 2) % 2).alias("parity"), call.alias("call_id"))


@query("TXT45_concatenate", f"with {O.PAIRS_SQL} select doc_id, trim(reference || ' ' || hypothesis) as text from pairs")
def concatenated(t: Tables) -> DataFrame:
    return O.pairs(t.documents).select("doc_id", F.trim(X.join_reads(F.col("reference"), F.col("hypothesis"))).alias("text"))


@query("TXT49_ordered_pages", "select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id")
def ordered(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(X.ordered_text(F.col("turn"), F.col("text")).alias("text"))


@query("CMP26_contrast_ratio", """with c as (select n_nationkey, n_nationkey * 10 % 256 / 255.0 as v from nation), l as (select n_nationkey, case when v <= 0.04045 then v / 12.92 else pow((v + 0.055) / 1.055, 2.4) end as l from c)
    select n_nationkey, round((greatest(l, 1.0) + 0.05) / (least(l, 1.0) + 0.05), 9) as contrast from l""")
def contrast(t: Tables) -> DataFrame:
    v = (F.col("n_nationkey") * 10 % 256) / 255.0
    lum = F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))
    return t.nation.select("n_nationkey", F.round((F.greatest(lum, F.lit(1.0)) + 0.05) / (F.least(lum, F.lit(1.0)) + 0.05), 9).alias("contrast"))
