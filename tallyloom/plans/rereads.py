"""Queries of further reads of pages. No SQL: alignments of whole texts; tests hold them against the kernels and plain definitions.

A conversation is a page, its turns are the lines. Its text is written in Thai letters, vowels as marks, one for one, so that whole
texts bear marks. The output is, by conv_id mod 5: the page, the page without one mark, its lines backwards, its first half, or the
page and a phrase over and over. There are two more reads of each page: one that takes one mark for another and one without its
second line. Null turns count as empty; empty pages stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import rereads as V
from tallyloom.functions import text as X
from tallyloom.plans.registry import Tables, query

# Letters, and the Thai ones that stand for them; vowels are marks.
LATIN, THAI = "bcdfghjklmnpqrstvwxyzaeiou", "กขคงจฉชซญดตถทธนบปพฟมยั้ิุ่"
#: Words that a dictionary may have; it goes to every task.
MOST_WORDS = 500_000


def thai(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, THAI)


def pages(conversations: DataFrame) -> DataFrame:
    """conv_id, reference, output, capped, second, third.

    Turns meet once, by conversation, over a stated number of partitions: alignments cost the square of a text's length, and
    adaptive execution would join partitions that are small in bytes.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = conversations.repartition(parts, "conv_id").groupBy("conv_id").agg(X.ordered_text(F.col("turn"), F.coalesce("text", F.lit(""))).alias("text"))
    r = r.select("conv_id", thai(F.col("text")).alias("reference"))
    k, t = F.col("conv_id") % 5, F.col("reference")
    lines = F.split(t, "\n")
    output = (
        F.when(k == 1, F.replace(t, F.lit("้"), F.lit(""))).when(k == 2, F.array_join(F.reverse(lines), "\n")).when(k == 3, F.left(t, F.ceil(F.length(t) / 2).cast("int")))
        .when(k == 4, F.concat(t, F.repeat(thai(F.lit(" over again")), F.lit(30)))).otherwise(t)
    )
    short = F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, F.greatest(F.lit(0), F.size(lines) - 2))), "\n")
    return r.withColumns({"output": output, "capped": k == 4, "second": F.replace(t, F.lit("ั"), F.lit("ิ")), "third": short})


@query("TXT44_fused_reads")
def fused(t: Tables) -> DataFrame:
    """The output with what only the second read has, with and without proof that it is new."""
    udf = G.each_udf(lambda a, b: {"fused": V.fuse(a, b), "all_runs": V.fuse(a, b, core=None)}, "fused: string, all_runs: string")
    r = pages(t.conversations).withColumn("f", udf("output", "second"))
    return r.select("conv_id", F.length("output").alias("anchor_chars"), F.length("f.fused").alias("chars"), F.length("f.all_runs").alias("all_chars"), F.sha2("f.fused", 256).alias("sha256"))


@query("KRN27_TXT47_TXT48_boundaries")
def boundaries(t: Tables) -> DataFrame:
    """Ends of lines in outputs, after which the next line was left out or, of two at most a page, read."""
    fields = "line int, kind string, marked int, actual string, expected string, prefix int"
    names = [f.split()[0] for f in fields.split(", ")]

    def one(ids, references, outputs):
        return ids.combine(references, lambda i, r: (i, r)).combine(outputs, lambda ir, o: [tuple(b[n] for n in names) for b in V.boundaries(*ir, o)])

    udf = F.pandas_udf(one, f"array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>")
    return pages(t.conversations).select("conv_id", F.explode(udf(F.col("conv_id"), "reference", "output")).alias("b")).select("conv_id", "b.*")


@query("KRN29_KRN30_TXT21_cluster_labels")
def labels(t: Tables) -> DataFrame:
    """Of each page its clusters with marks in lines that were read, and those in error."""

    def one(reference: str, output: str) -> dict:
        found = V.label_clusters(output, list(V.read_places(reference, output)))
        return {"clusters": len(found), "errors": sum(c["error"] for c in found), "consonant_errors": sum(c["consonant_error"] for c in found)}

    udf = G.each_udf(one, G.longs(["clusters", "errors", "consonant_errors"]))
    return pages(t.conversations).withColumn("c", udf("reference", "output")).select("conv_id", "c.*")


@query("KRN32_KRN33_view_votes")
def votes(t: Tables) -> DataFrame:
    """Status of each page's marks in the second read, and its output after a vote of all three reads at each consonant."""
    states = ["right", "wrong", "not_found"]

    def one(reference: str, output: str, second: str, third: str) -> dict:
        out = dict.fromkeys(states, 0)
        lines = G.reference_lines(reference)
        windows = [G.Windows(lines, second)]
        for line in lines:
            found = V.best_read(line, [second], windows)
            for i, c in enumerate(line):
                if c in G.MARKS:
                    out[V.view_status(line, i, found)] += 1
        flagged = [m.span() for m in V._CLUSTER.finditer(output) if K.component(m[0][0]) == "CONSONANT"]
        edits = V.flagged_edits(output, flagged, [[second], [third]])
        return out | {"flagged": len(flagged), "edits": len(edits), "text": V.apply_edits(output, edits)}

    udf = G.each_udf(one, G.longs([*states, "flagged", "edits"]) + ", text: string")
    r = pages(t.conversations).withColumn("v", udf("reference", "output", "second", "third"))
    return r.select("conv_id", *(F.col(f"v.{n}") for n in (*states, "flagged", "edits")), F.sha2("v.text", 256).alias("sha256"))


@query("KRN28_TXT28_lexical_classes")
def lexical(t: Tables) -> DataFrame:
    """Misread marks of the second read by what became of their words, in the dictionary of the benchmark's passages."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(thai(F.col("text")), F.lit(r"\S+"), F.lit(0))).alias("w")).distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
    lexicon = frozenset(w[0] for w in words)

    def one(reference: str, second: str) -> dict:
        found = V.lexical_classes(reference, second, lexicon)
        return {f"{kind}_{c}": found[kind][c] for kind in found for c in V.LEXICAL}

    names = [f"{kind}_{c}" for kind in K.CLASSES[:3] for c in V.LEXICAL]
    return pages(t.conversations).withColumn("x", G.each_udf(one, G.longs(names))("reference", "second")).select("conv_id", "x.*")


@query("KRN39_AGG36_consonant_flips")
def flips(t: Tables) -> DataFrame:
    """Consonants scored in the output and in the second read, and those that one of them alone read."""

    def one(reference: str, output: str, second: str) -> dict | None:
        a, b = V.consonants_read(reference, output), V.consonants_read(reference, second)
        return None if a is None or b is None else {"scored_in_both": len(b), "flips": sum(a[i] != right for i, right in b.items())}

    names = ["scored_in_both", "flips"]
    r = pages(t.conversations).withColumn("c", G.each_udf(one, G.longs(names))("reference", "output", "second"))
    return r.agg(F.count("*").alias("pages"), F.count("c.flips").alias("found_in_both"), *(F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in names))


@query("KRN40_site_correctness")
def sites(t: Tables) -> DataFrame:
    """Marks, and consonants without any, by kind: sites and those that the output has right."""
    r = pages(t.conversations).withColumn("sites", X.mark_sites(F.col("reference")))
    names = [f"{kind}_{n}" for kind in ("TONE", "UPPER", "LOWER", "TONE_ABSENT") for n in ("n", "correct")]

    def one(reference: str, output: str, kinds, places) -> dict:
        read, out = G.Read(K.align(reference, output), reference, output), dict.fromkeys(names, 0)
        for kind, i in zip(kinds, places, strict=True):
            out[f"{kind}_n"] += 1
            out[f"{kind}_correct"] += V.site_correct(kind, int(i), read, output)
        return out

    return r.withColumn("s", G.each_udf(one, G.longs(names))("reference", "output", "sites.kind", "sites.index")).select("conv_id", "s.*")


@query("PVL16_chance_found_rate")
def chance_found(t: Tables) -> DataFrame:
    """Share of pages that are found in the output of the next page, the last in that of the first: found by chance.

    Only ids are put in order; texts meet by joins on ids.
    """
    r = pages(t.conversations)
    ids = r.select("conv_id", (F.col("conv_id") % 2).alias("cell"))
    by = Window.partitionBy("cell").orderBy("conv_id")
    ids = ids.withColumns({"next": F.lead("conv_id").over(by), "first": F.first("conv_id").over(by)}).select("cell", "conv_id", F.coalesce("next", "first").alias("other"))
    pairs = ids.where("conv_id <> other").join(r.where("reference <> ''").select("conv_id", "reference"), "conv_id").join(r.select(F.col("conv_id").alias("other"), "output"), "other")
    edits = G.each_udf(lambda a, b: {"edits": K.best_window(a, b)[0]}, "edits: long")("reference", "output")["edits"]
    hit = pairs.select("cell", (edits / F.length("reference") <= V.FOUND).cast("int").alias("found"))
    return hit.groupBy("cell").agg(F.count("*").alias("pairs"), F.round(F.avg("found"), 9).alias("chance_found"))


@query("WIN17_pointed_lines")
def pointed_lines(t: Tables) -> DataFrame:
    """Lines of each page that are most like the middle of its output."""
    middle = F.substr("output", F.floor(F.length("output") / 3).cast("int") + 1, F.ceil(F.length("output") / 3).cast("int"))
    udf = G.each_udf(V.pointed, "answer: string, similarity: double, first: long, last: long")
    r = pages(t.conversations).withColumn("p", udf(middle, "reference"))
    return r.select("conv_id", "p.first", "p.last", F.round("p.similarity", 9).alias("similarity"), F.length("p.answer").alias("chars"), F.col("p.first").isNull().alias("fell_back"))


@query("AGG27_CMP29_loop_content")
def loop_content(t: Tables) -> DataFrame:
    """Outputs that reached the cap: how many repeat a unit, how many units bear marks, and the marks of looping and of all outputs."""

    def one(output: str, _: str) -> dict:
        found = K.loop_onset(output, *G.STOP)
        unit = "" if found is None else output[found[0] : sum(found)]
        return {"loops": int(found is not None), "marked": int(any(c in G.MARKS for c in unit)), "marks": int(G._is_mark(output, G.MARKS).sum())}

    r = pages(t.conversations).withColumn("l", G.each_udf(one, G.longs(["loops", "marked", "marks"]))("output", "output"))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))), F.lit(0))
    return r.agg(
        F.count("*").alias("n"), F.count_if("capped").alias("reached_max"), capped("l.loops").alias("exact_repeat"), capped("l.marked").alias("unit_has_marks"),
        capped("l.marks").alias("output_marks_in_looping"), F.coalesce(F.sum("l.marks"), F.lit(0)).alias("output_marks_all"),
    )


@query("AGG61_loops_at_budget")
def loops_at_budget(t: Tables) -> DataFrame:
    """Outputs at the cap whose end repeats a block: as they are, without their structure, and without a tag cut off at the end."""
    r = pages(t.conversations).where("capped").select(F.concat("output", F.lit(" <b")).alias("output"))
    structural = G.text_udf(G.unwrap_structure)("output")
    forms = r.select("output", structural.alias("s")).withColumn("c", F.rtrim(X.cut_partial_tag(F.col("s"))))
    loops = G.each_udf(lambda a, b: {"a": int(K.loop_period(a) is not None), "b": int(K.loop_period(b) is not None)}, "a: long, b: long")
    x = forms.select(loops("output", "s").alias("x"), loops("c", "c").alias("y"))
    return x.agg(
        F.count("*").alias("reached_max"), F.coalesce(F.sum("x.a"), F.lit(0)).alias("loop_raw"), F.coalesce(F.sum("x.b"), F.lit(0)).alias("loop_structural"),
        F.coalesce(F.sum("y.a"), F.lit(0)).alias("loop_structural_cut_tag"),
    )


@query("REP12_near_onsets")
def near_onsets(t: Tables) -> DataFrame:
    """Where outputs followed by numbered copies of a phrase loop if digits don't count, and the first token boundary after its first copy."""

    def one(output: str, _: str) -> dict:
        found = V.near_onset(output)
        if found is None:
            return {}
        ids, unit = output.split(" "), output[found[0] : found[1]]
        n = V.rollback(ids, found[1], " ".join)
        return {"onset": found[0], "end": found[1], "tokens_kept": n, "next_starts_unit": int(V.starts_unit("", unit[:4], V.unit_key(unit))), "next_completes_unit": int(V.completes_unit(output, unit, V.unit_key(unit)))}

    names = ["onset", "end", "tokens_kept", "next_starts_unit", "next_completes_unit"]
    copies = F.array_join(F.transform(F.sequence(F.lit(101), F.lit(112)), lambda n: F.concat(F.lit(" item no "), n.cast("string"))), "")
    numbered = F.when(F.col("conv_id") % 2 == 0, F.concat("output", copies)).otherwise(F.col("output"))
    r = pages(t.conversations).withColumn("text", numbered).withColumn("n", G.each_udf(one, G.longs(names))("text", "text"))
    return r.select("conv_id", F.length("text").alias("chars"), "n.*")


@query("REP13_stop_only")
def stop_only(t: Tables) -> DataFrame:
    """Outputs that loop, as if decoding had ended at the first copy's end: text and capped, and whether they changed."""
    cut = G.text_udf(lambda s: K.cut_at_loop(s, *G.STOP))
    r = pages(t.conversations).withColumn("kept", cut("output"))
    escaped = F.length("kept") < F.length("output")
    return r.select("conv_id", F.sha2("kept", 256).alias("sha256"), F.length("kept").alias("chars"), (F.col("capped") & ~escaped).alias("capped"), escaped.alias("escaped"))
