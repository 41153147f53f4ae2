"""Reading kernels against hand-worked cases and plain definitions, and their queries on a small table."""

import random

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tests.core.test_kernels import CASES, plain, some


def test_bit_parallel_distance():
    r = random.Random(3)
    long = ["".join(r.choice("abc ก่") for _ in range(r.randrange(60, 200))) for _ in range(60)]
    for a, b in CASES + list(zip(some(11, 400), some(12, 400), strict=True)) + list(zip(long, long[1:], strict=False)):
        assert G.edit_distance(a, b) == plain(a, b)
        s = G.edit_split(a, b)
        assert s["insertions"] + s["deletions"] + s["substitutions"] == s["edits"] and len(a) - s["deletions"] == len(b) - s["insertions"]
    assert G.edit_split("ab", "cd", 8) == {"edits": 2, "insertions": None, "deletions": None, "substitutions": None}


def test_edit_split_of_long_texts():
    ref = "\n".join(f"line {k} of some text" for k in range(150))
    out = "\n".join(ref.split("\n")[::-1])
    assert len(ref) ** 2 > 4_000_000
    s = G.edit_split(ref, out)
    assert s["edits"] == G.edit_distance(ref, out) == s["insertions"] + s["deletions"] + s["substitutions"]
    assert len(ref) - s["deletions"] == len(out) - s["insertions"]


def test_order_free_counts():
    ref = "น้ำไหลไฟสว่าง\nบ้านใหญ่มากๆ"
    whole = G.order_free(ref, ref)
    assert whole["correct"] == whole["reference_marks"] == whole["output_marks"] > 0 and whole["matched_lines"] == 2
    backwards = "\n".join(ref.split("\n")[::-1])
    assert G.order_free(ref, backwards)["correct"] == whole["correct"] > G.order_free(ref, backwards, way="whole")["correct"]
    lost = G.order_free(ref, ref.replace("้", ""))
    assert lost["correct"] == lost["output_marks"] == whole["correct"] - 2
    short = G.order_free("ก้าน\nบ้านใหญ่มากๆ", "บ้านใหญ่มากๆ ก้าน")
    assert short["eligible_lines"] == 1 and short["short_line_marks"] == 1 == short["reference_marks"] - short["correct"]
    assert G.order_free("ก้าน\nบ้านใหญ่มากๆ", "บ้านใหญ่มากๆ ก้าน", way="lines_and_rest")["correct"] == short["reference_marks"]
    looped = ref + "ก้าน " * 12
    c = G.order_free(ref, looped, copies_earn=False)
    assert c["repeat_marks"] == 11 and c["output_marks"] == whole["output_marks"] + 12 and c["correct"] == whole["correct"]
    twice = G.order_free("บ้านใหญ่มากๆ\nบ้านใหญ่มากๆ", "บ้านใหญ่มากๆ")
    assert twice["matched_lines"] == 1  # what one line has claimed is no other's
    assert G.order_free("", "")["correct"] == 0


def test_causes():
    a, b, c = "บ้านใหญ่มากๆ", "น้ำไหลไฟสว่าง", "ลมพัดแรงที่ชายป่า"
    text = "\n".join((a, b, c))
    assert [x for *_, x in G.line_causes(text, text)[1]] == [None] * 3 and set(G.attribute(text, text)) == {"correct"}
    assert [x for *_, x in G.line_causes(text, a + "\n" + c)[1]] == [None, "line_missing", None]
    moved = G.line_causes(text, a + "\n" + c + "\n" + b)[1]
    assert "line_reordered" in [x for *_, x in moved] and "line_missing" not in [x for *_, x in moved]
    near = G.line_causes(text, a + "\n" + c + "\n" + b.replace("ไฟ", "ไท"))[1]
    assert "line_reordered_approx" in [x for *_, x in near]
    assert G.attribute("ไฟฟ้า", "ไฟฟา") == {"misread_with_base": 1} and G.attribute("abก้", "ab") == {"span_missing": 1} and G.attribute("abก้cd", "abxycd") == {"misread_other": 1}
    assert sum(G.attribute(text, "xx").values()) == sum(ch in G.MARKS for ch in text)


def test_anchored_scores():
    s = G.anchored_score("ไฟฟ้า น้ำ", "before **ไฟฟา** น้ำ after", None)
    assert (s["edits"], s["located"], s["chars"], s["TONE_n"], s["TONE_correct"], s["TONE_base_error"]) == (1, 1, 9, 2, 1, 1)
    assert s["hyp_chars"] - s["window_chars"] == len("before  after")
    s = G.anchored_score("ไฟฟ้า น้ำ", "nothing", 0.5)
    assert (s["located"], s["edits"], s["TONE_deleted"]) == (0, 9, 2)
    s = G.anchored_score("abc", "x<figure>abc</figure>", None)
    assert (s["figures"], s["figure_only"]) == (1, 3)
    assert G.anchored_score("", "abc", None)["located"] == 0


def test_structure_and_windows():
    assert G.extract("## t\n**a** | `b` $c$ __d__\n```py\ne") == ("t a b c d e", 0, 0)
    assert G.unwrap_structure("a<figure><caption>c</caption><td>x</td></figure>b<figure>photo</figure>c").split() == ["a", "<td>x", "b", "c"]
    assert G.unwrap_structure("- one\n2. two\n**b** * c").split() == ["one", "two", "**b**", "c"]
    block = "a block of words, once more. "
    assert G.without_loop("start" + block * 4) == "start" + block and G.without_loop("plain") == "plain"
    assert G.window_label("12 - 3", "abc")[0] == "no_letter" and G.window_label("abd", "xx abc", 0.4) == ("read", 1 / 3) and G.window_label("abc", "")[1] == 1.0
    assert G.keep_windows("head one two three", 4, [(5, 8, 0.9), (9, 12, 0.1), (13, 18, 0.9)], 0.5) == "head one three"


def test_stops():
    text = "so " + "ab12" * 10 + "ab"
    p = G.stop_point(text)
    assert p == {"onset": 3, "unit": 4, "copies": 10, "fires_at": 35, "after_run": 2, "runaway": 1}
    assert G.stop_point(text + "zz")["runaway"] == 0 and G.stop_point(text + "�")["runaway"] == 1 and G.stop_point("none") is None
    assert G.first_stop(text, "".join) == 35 and G.first_stop("none", "".join) is None
    assert G.stopped(text, "".join) == K.cut_at_loop(text, *G.STOP) == "so ab12"


def test_queries(spark, tmp_path):
    from tallyloom.plans import reading as P
    from tallyloom.plans.registry import QUERIES

    r = random.Random(5)
    words = ["stone", "water", "river", "ไฟฟ้า", "น้ำ", "green", "<b>bold</b>"]
    line = lambda: " ".join(r.choice(words) for _ in range(8))
    rows = [(i, None if i == 7 else "" if i == 8 else "\n".join(line() for _ in range(4)), "en" if i < 25 else "th", f"s{i % 4}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    at = {x.doc_id: x for x in P.records(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert len(at) == 39
    for x in run("KRN2_KRN3_KRN4_bit_parallel_distance"):
        assert x.edits == plain(at[x.doc_id].reference, at[x.doc_id].output)
    free = {x.doc_id: x for x in run("KRN22_WIN12_order_free_counts")}
    assert all({k: free[i][k] for k in G.COUNTS} == G.order_free(a.reference, a.output, marks=P.VOWELS) for i, a in at.items())
    for x in run("AGG15_AGG16_order_free_cells"):
        of = [free[i] for i, a in at.items() if (a.task, a.prompt) == (x.task, x.prompt)]
        right, given, told = (sum(f[k] for f in of) for k in ("correct", "reference_marks", "output_marks"))
        assert x.n == len(of) and abs(x.f1 - 2 * right / (given + told)) < 1e-8
    for x in run("KRN23_KRN24_KRN25_mark_causes"):
        want = G.attribute(at[x.doc_id].reference, at[x.doc_id].output, marks=P.VOWELS)
        assert {k: x[k] for k in want} == dict(want) and x.correct + sum(x[c] for c in G.CAUSES) == sum(want.values())
    summary = {x.task: x for x in run("KRN20_AGG17_global_scores")}
    assert summary["en"].observations + summary["th"].observations == 39 and summary["en"].empty_references == 1
    cells = run("KRN21_AGG18_AGG19_PVL15_anchored_scores")
    assert len(cells) == 4 and all(0 < x.null_min <= x.threshold <= 1 and x.located_rate > 0.5 for x in cells)
    found = {x.doc_id: x.cause for x in run("KRN31_TXT4_REP3_DEC1_diagnosis")}
    assert found[8] == "empty_reference" and found[3] == "omission" and found[4] in ("loop", "overgeneration")
    stops = {x.doc_id: x for x in run("REP6_REP7_REP8_stops_at_loops")}
    assert all(s.stopped == (i % 5 == 4) and not s.capped for i, s in stops.items())
    effects = run("REP9_REP14_AGG64_stop_effects")
    assert len(effects) == sum(s.stopped for s in stops.values()) and all(x.marks_removed > 0 and x.surplus_after < x.surplus_before for x in effects)
    assert all(x.equal == 1 for x in run("REP11_first_stop"))
    d = run("BOO8_BOO9_BOO10_paired_f1_difference")[0]
    assert d.clusters == 4 and d.f1_low <= d.f1 <= d.f1_high and d.precision > 0
