"""Queries of what outputs read of whole documents. No SQL: alignments of whole texts; tests hold them against brute force.

Documents are the references. An output is, by doc_id mod 5: the text, the text without the letter e, its lines backwards, its
first half, or the text and a phrase over and over. Prompts are the parities of doc_id, tasks the languages, clusters the sources.
Vowels count as marks beside the Thai ones, as few texts are Thai. Null texts are left out, empty ones score null.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import text as X
from tallyloom.operators import resample as B
from tallyloom.plans.registry import Tables, query

VOWELS = G.MARKS | set("aeiou")
CELL = ["task", "prompt"]


def records(documents: DataFrame) -> DataFrame:
    """doc_id, task, prompt, source, reference, output, capped, tokens, seconds.

    An alignment costs the square of a text's length, far more than moving the text, so rows are dealt evenly first, over a
    stated number of partitions: adaptive execution would join those that are small in bytes.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t, k = F.col("reference"), F.col("doc_id") % 5
    out = (
        F.when(k == 1, F.replace(t, F.lit("e"), F.lit(""))).when(k == 2, F.array_join(F.reverse(F.split(t, "\n")), "\n"))
        .when(k == 3, F.left(t, F.ceil(F.length(t) / 2).cast("int"))).when(k == 4, F.concat(t, F.repeat(F.lit(" over again"), F.lit(30)))).otherwise(t)
    )
    r = documents.where("text is not null").select("doc_id", F.col("lang").alias("task"), (F.col("doc_id") % 2).alias("prompt"), "source", F.col("text").alias("reference"))
    r = r.repartition(parts, "doc_id").withColumn("output", out).withColumns({"capped": k == 4, "tokens": F.ceil(F.length("output") / 4)})
    return r.withColumn("seconds", F.col("tokens") * 0.02)


def _rate(num: Column, den: Column, name: str) -> Column:
    return F.round(F.try_divide(num, den), 9).alias(name)


def f1(correct: Column, reference: Column, output: Column) -> dict[str, Column]:
    """precision, recall and F1 of sums; null where a side has no marks, F1 0 where nothing is correct."""
    p, r = F.try_divide(correct, output), F.try_divide(correct, reference)
    return {"precision": p, "recall": r, "f1": F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))}


def counts(r: DataFrame, output: str = "output", **how) -> DataFrame:
    """Adds the order-free counts of a column of outputs."""
    udf = G.each_udf(partial(G.order_free, marks=VOWELS, **how), G.longs(G.COUNTS))
    return r.withColumn("c", udf("reference", output)).select(*r.columns, "c.*")


@query("KRN2_KRN3_KRN4_bit_parallel_distance")
def distances(t: Tables) -> DataFrame:
    udf = F.pandas_udf(lambda a, b: a.combine(b, G.edit_distance), "long")
    return records(t.documents).select("doc_id", udf("reference", "output").alias("edits"))


@query("KRN17_edit_split")
def split(t: Tables) -> DataFrame:
    udf = G.each_udf(G.edit_split, G.longs(["edits", "insertions", "deletions", "substitutions"]))
    return records(t.documents).withColumn("e", udf("reference", "output")).select("doc_id", "e.*")


@query("KRN22_WIN12_order_free_counts")
def order_free(t: Tables) -> DataFrame:
    return counts(records(t.documents)).select("doc_id", *G.COUNTS)


@query("AGG15_AGG16_order_free_cells")
def cells(t: Tables) -> DataFrame:
    """Micro rates of each task and prompt."""
    s = counts(records(t.documents)).groupBy(*CELL).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in G.COUNTS))
    rates = f1(F.col("correct"), F.col("reference_marks"), F.col("output_marks"))
    return s.select("*", *(F.round(v, 9).alias(k) for k, v in rates.items()), _rate(F.col("short_line_marks"), F.col("reference_marks"), "short_line_share"))


@query("KRN23_KRN24_KRN25_mark_causes")
def causes(t: Tables) -> DataFrame:
    """Of each document the marks by outcome, and of its lines how many are lost as a whole and why."""

    def one(reference: str, output: str) -> dict:
        found = G.line_causes(reference, output)
        lost = [cause for _, _, cause in found[1]]
        return G.attribute(reference, output, marks=VOWELS, lost=found) | {f"{c}_lines": lost.count(c) for c in G.CAUSES[:3]} | {"lines": len(lost)}

    names = ["correct", *G.CAUSES, *(f"{c}_lines" for c in G.CAUSES[:3]), "lines"]
    udf = G.each_udf(one, G.longs(names))
    return records(t.documents).withColumn("a", udf("reference", "output")).select("doc_id", *(F.coalesce(f"a.{n}", F.lit(0)).alias(n) for n in names))


def _summary(scored: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Rates of scored rows, and more aggregates; documents without text count as observations only."""
    has, total = F.col("chars") > 0, lambda c: F.sum(F.when(F.col("chars") > 0, F.col(c)))
    marks = []
    for k in K.CLASSES[:3]:
        wrong = total(f"{k}_n") - total(f"{k}_correct")
        marks += [
            total(f"{k}_n").alias(f"{k}_n"), _rate(wrong, total(f"{k}_n"), f"{k}_error"), _rate(total(f"{k}_base_error"), total(f"{k}_base_n"), f"{k}_mark_error"),
            _rate(total(f"{k}_deleted"), wrong, f"{k}_deleted_share"), _rate(total(f"{k}_same_class"), wrong, f"{k}_same_class_share"),
        ]
    return scored.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.count_if(~has).alias("empty_references"), F.round(F.avg(F.try_divide("edits", "chars")), 9).alias("macro_cer"),
        _rate(total("edits"), total("chars"), "micro_cer"), _rate(total("CONSONANT_n") - total("CONSONANT_correct"), total("CONSONANT_n"), "consonant_error"),
        F.round(F.avg(F.col("capped").cast("int")), 9).alias("capped_rate"), F.round(F.avg(F.col("repetitive").cast("int")), 9).alias("repetitive_rate"),
        F.round(F.percentile(F.try_divide("seconds", "tokens"), 0.5), 9).alias("median_seconds_per_token"), *marks, *more,
    )


@query("KRN20_AGG17_global_scores")
def global_scores(t: Tables) -> DataFrame:
    """Rates of each task after markup is normalised. Lexical classes of errors (KRN28) need a word list and are not here."""
    r = records(t.documents).withColumns({"repetitive": K.repetitive_udf()("output"), "reference": X.normalize_markup("reference"), "output": X.normalize_markup("output")})
    udf = G.each_udf(G.global_score, G.longs(["edits", *K._MARKS]))
    s = r.withColumn("s", udf("reference", "output")).select("task", "capped", "repetitive", "seconds", "tokens", F.length("reference").alias("chars"), "s.*")
    return _summary(s, ["task"])


def chance_thresholds(r: DataFrame, seed: int, quantile: float = 0.05) -> DataFrame:
    """Of each cell the rate that outputs of other references reach by chance: threshold, null_min, null_median, n.

    References are put in an order by digest and held against the next one's output, the last against the first's. Only ids are
    ordered; texts meet by joins on ids. A cell of one reference has no threshold.
    """
    by = Window.partitionBy(*CELL).orderBy("h", "doc_id")
    ids = r.where(F.length("reference") > 0).select(*CELL, "doc_id", X.digest(seed, F.col("doc_id")).alias("h"))
    ids = ids.withColumns({"next": F.lead("doc_id").over(by), "first": F.first("doc_id").over(by)})
    ids = ids.select(*CELL, "doc_id", F.coalesce("next", "first").alias("other")).where("doc_id <> other")
    pairs = ids.join(r.select("doc_id", "reference"), "doc_id").join(r.select(F.col("doc_id").alias("other"), "output"), "other")
    rate = pairs.select(*CELL, "doc_id", (G.each_udf(_chance, "edits: long, chars: long")("reference", "output")).alias("e"))
    rate = rate.where("e.chars > 0").select(*CELL, "doc_id", (F.col("e.edits") / F.col("e.chars")).alias("rate"))
    ranked = rate.withColumns({"k": F.row_number().over(Window.partitionBy(*CELL).orderBy("rate", "doc_id")) - 1, "n": F.count("*").over(Window.partitionBy(*CELL))})
    return ranked.groupBy(*CELL).agg(
        F.max(F.when(F.col("k") == F.floor(quantile * F.col("n")), F.col("rate"))).alias("threshold"), F.min("rate").alias("null_min"),
        F.percentile("rate", 0.5).alias("null_median"), F.max("n").alias("null_n"),
    )


def _chance(reference: str, output: str) -> dict[str, int]:
    ref, hyp = G.extract(reference)[0], G.extract(output)[0]
    return {"edits": min(K.bit_costs(K._codes(ref), K._codes(hyp), free_start=True)), "chars": len(ref)}


@query("KRN21_AGG18_AGG19_PVL15_anchored_scores")
def anchored_scores(t: Tables) -> DataFrame:
    """Rates of each cell whose outputs count as read below the cell's chance threshold only."""
    r = records(t.documents)
    chance = chance_thresholds(r, 7)
    at = r.join(F.broadcast(chance), CELL, "left")  # one row a cell: cells are languages by prompts
    udf = G.each_udf(G.anchored_score, G.longs([*G.SCORED, *K._MARKS]))
    s = at.withColumns({"repetitive": K.repetitive_udf()("output"), "s": udf("reference", "output", "threshold")})
    null = ("threshold", "null_min", "null_median", "null_n")
    s = s.select(*CELL, "capped", "repetitive", "seconds", "tokens", *null, "s.*")
    has = F.col("chars") > 0
    figure = has & (F.col("figures") > 0)
    half = lambda num, name: F.round(F.percentile(F.when(has, F.try_divide(num, "chars")), 0.5), 9).alias(name)
    return _summary(
        s, CELL, half("edits", "median_cer"), half("edits_raw", "median_cer_raw"), half(F.col("hyp_chars") - F.col("window_chars"), "median_overgeneration"),
        F.round(F.avg(F.when(has, F.col("located"))), 9).alias("located_rate"), F.count_if(figure).alias("outputs_with_figure"),
        F.count_if(has & (F.col("unclosed_figures") > 0)).alias("unclosed_figure_outputs"), F.round(F.avg(F.when(figure, F.try_divide("figure_only", "chars"))), 9).alias("figure_only_share"),
        *(F.round(F.max(c), 9).alias(c) for c in null),
    )



# What makes a cause the first one of a poor rate.
FORMAT_GAP, LOOP_SHARE, OMITTED, SURPLUS, ORDER_BAG, ORDER_CER = 0.20, 0.30, 0.70, 0.70, 0.90, 0.30


def cause(d: dict[str, Column]) -> Column:
    """The first cause in order of priority, from rates and shares of one output."""
    return (
        F.when(d["cer"].isNull(), "empty_reference")
        .when((d["cer"] - F.coalesce(d["cer_structural"], F.lit(0.0)) >= FORMAT_GAP) & (d["thai_lost"] > 0), "format_loss")
        .when(d["looped"] >= LOOP_SHARE, "loop").when(d["recall"] < OMITTED, "omission").when(d["precision"] < SURPLUS, "overgeneration")
        .when((d["recall"] >= ORDER_BAG) & (F.coalesce(d["cer_delooped"], F.lit(0.0)) >= ORDER_CER), "reading_order").otherwise("misread")
    )


def three_distances(r: str, h: str, rs: str, hs: str, hd: str) -> dict[str, int]:
    """Edits of each normalisation; texts that two of them leave alike are held against each other once."""
    known: dict[tuple[str, str], int] = {}
    for pair in ((r, h), (rs, hs), (rs, hd)):
        if pair not in known:
            known[pair] = G.edit_distance(*pair)
    return {"e": known[r, h], "es": known[rs, hs], "ed": known[rs, hd]}


def diagnosed(r: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, rates of reference and output under three normalisations, shares and the primary cause."""
    plain, structural = X.normalize_markup, G.text_udf(G.unwrap_structure)
    r = r.withColumn("delooped", G.text_udf(G.without_loop)("output"))
    n = r.select(
        *keep, F.length("output").alias("raw"), F.length("delooped").alias("kept"), X.thai_count(F.col("output")).alias("thai"), plain("reference").alias("r"), plain("output").alias("h"),
        plain(structural("reference")).alias("rs"), plain(structural("output")).alias("hs"), plain(structural("delooped")).alias("hd"),
    )
    edits = G.each_udf(three_distances, G.longs(["e", "es", "ed"]))
    n = n.withColumn("d", edits("r", "h", "rs", "hs", "hd")).select("*", "d.*").withColumns({"b": G.each_udf(G.bag, G.longs(["common", "reference_bag", "hypothesis_bag"]))("rs", "hd")})
    d = {
        "cer": F.try_divide("e", F.length("r")), "cer_structural": F.try_divide("es", F.length("rs")), "cer_delooped": F.try_divide("ed", F.length("rs")),
        "thai_lost": F.greatest(F.lit(0), F.col("thai") - X.thai_count(F.col("h"))), "looped": (F.col("raw") - F.col("kept")) / F.greatest(F.lit(1), F.col("raw")),
        "recall": F.col("b.common") / F.greatest(F.lit(1), F.col("b.reference_bag")), "precision": F.col("b.common") / F.greatest(F.lit(1), F.col("b.hypothesis_bag")),
    }
    return n.select(*keep, *(v.alias(k) for k, v in d.items()), cause(d).alias("cause"))


@query("KRN31_TXT4_REP3_DEC1_diagnosis")
def diagnosis(t: Tables) -> DataFrame:
    """Rates under three normalisations, shares and the primary cause of each output."""
    return diagnosed(records(t.documents), ["doc_id"])


def stop_outputs(r: DataFrame) -> DataFrame:
    """Adds cut (the output at a stop of any loop), cut_capped (one of capped outputs only, sooner) and point."""
    capped = F.when(F.col("capped"), G.text_udf(lambda t: K.cut_at_loop(t, 4, 3))("output")).otherwise(F.col("output"))
    point = G.each_udf(lambda t, _: G.stop_point(t), G.longs(G.STOP_POINT))("output", "output")
    # the cut is where the run's first copy ends
    r = r.withColumns({"cut_capped": capped, "point": point})
    return r.withColumn("cut", F.when(F.col("point.onset").isNull(), F.col("output")).otherwise(F.left("output", (F.col("point.onset") + F.col("point.unit")).cast("int"))))


@query("REP6_REP7_REP8_stops_at_loops")
def stops(t: Tables) -> DataFrame:
    """Where each output is stopped and what it would have cost: tokens and seconds by the share of characters that stay."""
    s = stop_outputs(records(t.documents)).withColumn("share", F.length("cut") / F.greatest(F.lit(1), F.length("output")))
    same = F.col("cut") == F.col("output")
    return s.select(
        "doc_id", (~same).alias("stopped"), (F.col("capped") & same).alias("capped"), F.length("cut").alias("kept"), F.length("cut_capped").alias("kept_capped"),
        F.rint(F.col("tokens") * F.col("share")).cast("long").alias("tokens"), F.round(F.col("seconds") * F.col("share"), 9).alias("seconds"), "point.*",
    )


@query("REP9_REP14_AGG64_stop_effects")
def stop_effects(t: Tables) -> DataFrame:
    """What the stop removed from each output it changed, and the surplus marks before and after."""
    s = stop_outputs(records(t.documents)).where(F.col("cut") != F.col("output"))
    both = counts(s).withColumns({"before": F.struct("output_marks", "correct"), "ended": ~F.col("capped")}).select(*s.columns, "before", "ended")
    c = counts(both, "cut")
    return c.select(
        "doc_id", "ended", "point.*", (F.col("before.output_marks") - F.col("output_marks")).alias("marks_removed"), (F.col("before.correct") - F.col("correct")).alias("credit_removed"),
        (F.col("before.output_marks") - F.col("before.correct")).alias("surplus_before"), (F.col("output_marks") - F.col("correct")).alias("surplus_after"),
        F.rint(F.col("tokens") / F.length("output") * (F.col("point.onset") + F.col("point.unit"))).cast("long").alias("tokens_to_first_copy"),
        F.rint(F.col("tokens") / F.length("output") * F.least(F.length("output"), F.col("point.fires_at"))).cast("long").alias("tokens_to_detection"),
    )


@query("REP11_first_stop")
def first_stops(t: Tables) -> DataFrame:
    """Words after which each output's loop is first there, and whether stopping then gives the output cut afterwards."""

    def one(output: str, _: str) -> dict:
        ids = output.split(" ")
        n = G.first_stop(ids, " ".join)
        return {"tokens": len(ids), "stopped_at": n, "equal": int((output if n is None else K.cut_at_loop(" ".join(ids[:n]), *G.STOP)) == K.cut_at_loop(output, *G.STOP))}

    return records(t.documents).withColumn("s", G.each_udf(one, G.longs(["tokens", "stopped_at", "equal"]))("output", "output")).select("doc_id", "s.*")


#: Draws of the bootstrap of F1.
DRAWS = 2_000


def stopped_and_not(reference: str, output: str, cut: str) -> dict[str, int]:
    """Counts of an output (a) and of it as stopped (b), which mostly is the same."""
    a = G.order_free(reference, output, marks=VOWELS)
    b = a if cut == output else G.order_free(reference, cut, marks=VOWELS)
    return {f"{s}_{c}": n[c] for s, n in (("a", a), ("b", b)) for c in ("correct", "reference_marks", "output_marks")}


@query("BOO8_BOO9_BOO10_paired_f1_difference")
def f1_difference(t: Tables) -> DataFrame:
    """Difference of F1, recall and precision between stopped outputs and outputs, whole sources drawn, one plan for both sides."""
    r = stop_outputs(records(t.documents))
    each = G.each_udf(stopped_and_not, G.longs([f"{side}_{c}" for side in "ab" for c in ("correct", "reference_marks", "output_marks")]))
    side = lambda s: F.struct(*(F.col(f"c.{s}_{c}").alias(c) for c in ("correct", "reference_marks", "output_marks"))).alias(s)
    b = r.withColumn("c", each("reference", "output", "cut")).select("source", side("a"), side("b"))
    names = {f"{side}_{c}": F.col(f"{side}.{c}") for side in "ab" for c in ("correct", "reference_marks", "output_marks")}
    clusters = B.cluster_sums(b, "source", [], names)
    difference = lambda: {k: f1(*(F.col(f"b_{c}") for c in ("correct", "reference_marks", "output_marks")))[k] - f1(*(F.col(f"a_{c}") for c in ("correct", "reference_marks", "output_marks")))[k] for k in ("f1", "recall", "precision")}
    point = clusters.agg(*(F.sum(n).alias(n) for n in names), F.count("*").alias("clusters")).select("clusters", *(F.round(v, 9).alias(k) for k, v in difference().items()))
    draws = B.draw_sums(clusters, B.plan(clusters, [], DRAWS, 41), [], list(names)).select(*(v.alias(k) for k, v in difference().items()))
    ends = [F.round(v, 9).alias(f"{k}_{end}") for k in ("f1", "recall", "precision") for end, v in zip(("low", "high"), B.index_quantiles(F.col(k)), strict=True)]
    return point.join(draws.agg(*ends), how="cross")
