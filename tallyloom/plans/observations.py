"""Observation tables derived from the document table: a line as reference, and what an arm made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a document may have.
LINES = 1 << 20
#: Arms of the derived study, and how many letters in a hundred each one loses at its level.
ARMS = ("FULL", "A_75", "A_50", "A_25", "B_75", "B_50", "B_25")


def observed(text: Column) -> Column:
    """The text with each character other than printable ASCII as one that is, by its code point: a byte for a character, so that distances
    in bytes are distances in characters."""
    one = lambda c: F.when(c.rlike("[ -~]"), c).otherwise(F.char(33 + F.ascii(c) % 94))
    mapped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(text.rlike("[^ -~]"), mapped).otherwise(text)


def hypothesis(ref: Column, doc_id: Column) -> Column:
    """What is left without the letter e for each third document, the text with an x otherwise."""
    return F.when(doc_id % 3 == 0, F.replace(ref, F.lit("e"), F.lit(""))).otherwise(F.concat(ref, F.lit("x")))


_OBSERVED = "case when regexp_matches(line, '[^ -~]') then array_to_string(list_transform(regexp_extract_all(line, '(?s).'), lambda c: case when regexp_matches(c, '[ -~]') then c else chr(33 + ord(c) % 94) end), '') else line end"
PAIRS_SQL = f"""pairs as (select doc_id, lang, source, reference, case when doc_id % 3 = 0 then replace(reference, 'e', '') else reference || 'x' end as hypothesis from (select doc_id * {LINES} + i - 1 as doc_id, lang, source, {_OBSERVED} as reference
    from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where line <> ''))"""


def pairs(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, reference, hypothesis: one observation for each line of each document. doc_id is the line's: the document's
    id times LINES and the line's number. Empty lines, and null texts, are none."""
    lines = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("_i", "_line")).where("_line <> ''")
    ref = lines.select((F.col("doc_id") * LINES + F.col("_i")).alias("doc_id"), "lang", "source", observed(F.col("_line")).alias("reference"))
    return ref.withColumn("hypothesis", hypothesis(F.col("reference"), F.col("doc_id")))


def arms(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, condition_id, reference, hypothesis: each document under each arm it has (every 11th lacks B_25)."""
    base = pairs(documents).select("doc_id", "lang", "source", "reference", F.explode(F.array(*map(F.lit, ARMS))).alias("condition_id"))
    level = F.when(F.col("condition_id").endswith("75"), 1).when(F.col("condition_id").endswith("50"), 2).when(F.col("condition_id").endswith("25"), 3).otherwise(0)
    cut = (level * F.when(F.col("condition_id").startswith("A"), 1).otherwise(2) * (1 + F.col("doc_id") % 5)).cast("int")
    out = base.withColumn("hypothesis", F.substr("reference", F.lit(1), F.greatest(F.lit(0), F.length("reference") - cut)))
    return out.where(~((F.col("doc_id") % 11 == 0) & (F.col("condition_id") == "B_25")))


ARMS_SQL = (
    PAIRS_SQL
    + """, arms as (select doc_id, lang, source, condition_id, reference, substr(reference, 1, greatest(0, length(reference) - cut)::int) as hypothesis from (
    select *, (case when condition_id like '%75' then 1 when condition_id like '%50' then 2 when condition_id like '%25' then 3 else 0 end) * (case when condition_id like 'A%' then 1 else 2 end) * (1 + doc_id % 5) as cut
    from pairs, (select unnest(['FULL', 'A_75', 'A_50', 'A_25', 'B_75', 'B_50', 'B_25']) as condition_id))
    where not (doc_id % 11 = 0 and condition_id = 'B_25'))"""
)
