"""Queries of the text kernels; each distinct pair is sent to Python once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.plans import observations as O
from tallyloom.plans.registry import Tables, query


@query("KRN6_KRN9_alignment_errors", f"with {O.PAIRS_SQL} select doc_id, levenshtein(reference, hypothesis) as errors from pairs")
def errors(t: Tables) -> DataFrame:
    e = O.pairs(t.documents).select("doc_id", K.component_errors_udf()("reference", "hypothesis").alias("e"))
    total = sum((F.col(f"e.{f}") for f in K._ERRORS[1:]), F.col(f"e.{K._ERRORS[0]}"))
    return e.select("doc_id", total.alias("errors"))


@query("KRN2_KRN3_KRN4_line_distances", f"with {O.PAIRS_SQL} select doc_id, levenshtein(reference, hypothesis) as edits from pairs")
def line_distances(t: Tables) -> DataFrame:
    """Distances of all lines, with the matrix's columns as bits."""
    udf = F.pandas_udf(lambda a, b: a.combine(b, G.edit_distance), "long")
    return O.pairs(t.documents).select("doc_id", udf("reference", "hypothesis").alias("edits"))


@query("KRN7_KRN14_anchored_cer")
def anchored(t: Tables) -> DataFrame:
    p = O.pairs(t.documents).withColumn("a", K.anchored_udf()("reference", F.concat(F.lit("before "), "hypothesis", F.lit(" after"))))
    return p.select("doc_id", "a.distance", "a.start", "a.end", F.round(F.col("a.distance") / F.length("reference"), 9).alias("cer"))


@query("KRN8_KRN15_best_window")
def windowed(t: Tables) -> DataFrame:
    p = O.pairs(t.documents).withColumn("w", K.window_udf()("reference", F.concat("hypothesis", F.lit(" and "), "hypothesis")))
    return p.select("doc_id", "w.distance", "w.start", "w.end", (2 * F.col("w.distance") <= F.length("reference")).alias("found"))


@query("KRN10_KRN11_KRN12_mark_decomposition")
def marks(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("ไฟฟ้า น้ำ ก"), (F.col("doc_id") % 7).cast("string"), F.lit("กี่ปู่"))
    hyp = F.when(F.col("doc_id") % 2 == 0, F.replace(ref, F.lit("้"), F.lit(""))).otherwise(F.replace(ref, F.lit("ี"), F.lit("ิ")))
    each = t.documents.select("doc_id", ref.alias("r"), hyp.alias("h"))
    scored = each.select("r", "h").distinct().withColumn("m", K.mark_counts_udf()("r", "h"))
    return each.join(scored, ["r", "h"]).select("doc_id", "m.*")


@query("REP1_repetitive_tail")
def tail(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", K.repetitive_udf()(F.substring("text", -200, 200)).alias("repetitive"))


@query("REP2_REP4_REP5_REP6_loops")
def loops(t: Tables) -> DataFrame:
    head = t.documents.select("doc_id", "text")
    return head.select("doc_id", K.loops_udf()(F.col("text")).alias("l")).select("doc_id", "l.*")
