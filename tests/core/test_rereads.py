"""Kernels of further reads against hand-worked cases and plain definitions, and their queries on a small table."""

import random
import time

from pyspark.sql import functions as F

from tallyloom.functions import kernels as K
from tallyloom.functions import reading as G
from tallyloom.functions import rereads as V
from tallyloom.functions import text as X

A, B, C = "บ้านใหญ่มากๆ", "น้ำไหลไฟสว่าง", "ลมพัดแรงที่ชายป่า"


def test_fuse():
    assert V.fuse("abc", "") == "abc" and V.fuse("", "abcdefghijkl") == "abcdefghijkl" and V.fuse("", "abc") == ""
    assert V.fuse("one two", "one 0123456789 two") == "one 0123456789 two"
    assert V.fuse("one two", "one 012345678 two") == "one 012345678 two"  # with its space the run has ten characters
    assert V.fuse("one two", "one 01234567 two") == "one two"
    block = "a block that was read"
    assert V.fuse(f"one two {block}", f"{block} one two {block}") == f"one two {block}"
    assert V.fuse(f"one two {block}", f"{block} one two {block}", core=None) == f"{block} one two {block}"
    assert V.fuse("xbx", "xcx") == "xbx"


def test_places():
    assert V.nearest_end("ab--ab--ab", "ab", 5) == 6 and V.nearest_end("ab--ab--ab", "ab", 4) == 2 and V.nearest_end("ab", "cd", 0) is None
    assert V.nearest_end("x" * 100 + "end", "the end", 10) is None and V.nearest_end("x" * 100 + " end", "end", 80) == 104
    assert V.raw_position("a\nb  c d", "a b c") == 6 and V.raw_position("abc", "") is None and V.raw_position("a<b>b", "ab") is None
    assert V.raw_position("ab ab ab", "ab ab", tail=2) == 5


def test_boundaries():
    text = "\n".join((A, B, C))
    read = V.boundaries(1, text, text, controls=9)
    assert [(b["line"], b["kind"]) for b in read] == [(1, "control")] and text[read[0]["prefix"] :].startswith(B[:8])
    assert (read[0]["actual"], read[0]["expected"]) == (B[:12], C[:12])
    skipped = V.boundaries(1, text, f"{A}\n{C}")
    assert [(b["line"], b["kind"], b["marked"], b["expected"]) for b in skipped] == [(1, "skip", 1, B[:12])] and skipped[0]["actual"] == C[:12]
    many = "\n".join(f"{chr(ord('a') + i)} line of its own {i * 7919}" for i in range(9))
    assert len(V.boundaries(1, many, many)) == 2 and len(V.boundaries(1, many, many, controls=20)) == 7 and V.boundaries(1, many, many) == V.boundaries(1, many, many)
    assert V.boundaries(1, "", "") == [] == V.boundaries(1, text, "")


def test_views_and_votes():
    line = "ไฟฟ้า น้ำใส"
    place = line.index("้")
    wrong, right = V.best_read(line, ["x", line.replace("ฟ้", "ฟ")]), V.best_read(line, ["other text", f"so {line} on"])
    assert (V.view_status(line, place, right), V.view_status(line, place, wrong), V.view_status(line, place, V.best_read(line, ["", "nothing"]))) == ("right", "wrong", "not_found")
    assert V.view_vote(place - 1, right) == "ฟ้" and V.view_vote(place - 1, wrong) == "ฟ" and V.view_vote(0, None) is None and V.best_read("", ["a"]) is None
    assert V.majority("a", ["b", "b"]) == "b" and V.majority("a", ["b", None]) == "a" and V.majority("a", ["b", "c", "b"]) == "a"
    own = line.replace("ฟ้", "ฟ")
    spans = [m.span() for m in V._CLUSTER.finditer(own)]
    edits = V.flagged_edits(own, spans, [[line], [line]])
    assert edits == [(2, 3, "ฟ้")] and V.apply_edits(own, edits) == line
    assert V.flagged_edits(own, spans, [[line]]) == [] == V.flagged_edits("ฟา", [(0, 1)], [["ฟ้า"], ["ฟ้า"]])  # no majority; a short line
    assert V.apply_edits("abcdef", [(1, 3, "X"), (2, 4, "Y"), (4, 4, "Z")]) == "aXdZef"


def test_labels():
    label = lambda reference, output: V.label_clusters(output, list(V.read_places(reference, output)))
    bearing = sum(bool(V.marks_on(A, m.start())) for m in V._CLUSTER.finditer(A))
    same = label(A, A)
    assert len(same) == bearing and not any(c["error"] or c["consonant_error"] for c in same)
    lost = label(A, A.replace("้", ""))
    assert len(lost) == bearing and sum(c["error"] for c in lost) == 1
    assert label(A, f"<figure>{A}</figure>") == [] == label(A, "nothing like it") == label("", A)
    assert V.start_of("กี้", 2) == 0 and V.marks_on("กี้า", 0) == "ี้" and V.marks_on("abc", 0) == "" == V.marks_on("ก", 5)


def test_lexicon():
    words = {"ไฟฟ้า", "ข้าว", "ขาว", "น้ำ", "ไฟ"}
    assert [("ไฟฟ้าขาว xxน้ำ")[a:b] for a, b in V.word_spans("ไฟฟ้าขาว xxน้ำ", words)] == ["ไฟฟ้า", "ขาว", "xx", "น้ำ"] and V.word_spans("", words) == [] and V.word_spans("ab c", []) == [(0, 2), (3, 4)]
    one = lambda a, b: dict(V.lexical_classes(a, b, words)["TONE"])
    assert one("ข้าว", "ขาว") == {"real_word": 1} and one("ไฟฟ้า", "ไฟฟา") == {"non_word": 1} and one("น้ำ", "") == {"word_lost": 1}
    assert one("ก้อน", "กอน") == {"reference_not_in_lexicon": 1} and one("น้ำ", "น้ำ") == {}


def test_sites_and_pointers():
    assert V.consonants_read("ไฟฟ้า", "so ไฟฟ้า") == {1: True, 2: True} and V.consonants_read("ไฟฟ้า", "xxx") is None is V.consonants_read("", "a")
    assert V.consonants_read("กขค", "กxค") == {0: True, 1: False, 2: True}
    right = lambda kind, i, a, b: V.site_correct(kind, i, G.Read(K.align(a, b), a, b), b)
    assert right("TONE", 1, "ก้า", "ก้า") and not right("TONE", 1, "ก้า", "กา") and right("TONE_ABSENT", 0, "กา", "กา") and not right("TONE_ABSENT", 0, "กา", "ก้า")
    p = V.pointed("two three", "one\ntwo\nthree\nfour")
    assert (p["answer"], p["first"], p["last"], p["similarity"]) == ("two three", 1, 3, 1.0)
    assert V.pointed("zzz", "one\ntwo")["first"] is None and V.pointed("zzz", "")["similarity"] is None and V.pointed("ab", "ab\nab")["first"] == 0


def test_near_loops():
    text = "so it is " + "".join(f"item {n}, " for n in range(95, 107))
    onset, end = V.near_onset(text)
    assert K.loop_onset(text, *G.STOP) is None and text[onset:end] == " item 95,"
    assert V.near_onset("nothing here") is None and V.collapse_digits("a12๓b") == ("a0b", [0, 1, 4])
    ids = ["ab", "c", "def"]
    assert [V.rollback(ids, n, "".join) for n in (0, 1, 2, 3, 4, 6, 9)] == [0, 1, 1, 2, 3, 3, 3]
    assert V.starts_unit("", "it", "item0") and V.starts_unit("it", "em 42 x", "item0") and not V.starts_unit("x", "i", "item0") and not V.starts_unit("it", " ", "item0") and not V.starts_unit("it", "z", "item0")
    assert V.completes_unit("item 1 it", "em 22", "item0") and not V.completes_unit("item 1", " it", "item0")


def test_queries(spark, tmp_path):
    from tallyloom.plans import rereads as P
    from tallyloom.plans.registry import QUERIES

    r = random.Random(8)
    words = ["stone", "water", "river", "green", "a", "light"]
    rows = [(c, n, None if (c, n) == (3, 1) else " ".join(r.choice(words) for _ in range(7))) for c in range(20) for n in range(5)] + [(20, 0, None), (21, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([("stone water",), (None,)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    at = {x.conv_id: x for x in P.pages(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    assert len(at) == 22 and at[20].reference == "" and all(len(at[i].reference) == len("\n".join(t or "" for c, _, t in rows if c == i)) for i in at)
    for x in run("TXT44_fused_reads"):
        assert x.chars == len(V.fuse(at[x.conv_id].output, at[x.conv_id].second)) <= x.all_chars
    ends = [(x.conv_id, x.line, x.kind, x.prefix) for x in run("KRN27_TXT47_TXT48_boundaries")]
    assert sorted(ends) == sorted((i, b["line"], b["kind"], b["prefix"]) for i, a in at.items() for b in V.boundaries(i, a.reference, a.output)) and ends
    for x in run("KRN29_KRN30_TXT21_cluster_labels"):
        found = V.label_clusters(at[x.conv_id].output, list(V.read_places(at[x.conv_id].reference, at[x.conv_id].output)))
        assert (x.clusters, x.errors) == (len(found), sum(c["error"] for c in found))
    votes = {x.conv_id: x for x in run("KRN32_KRN33_view_votes")}
    assert all(v.right + v.wrong + v.not_found == sum(c in G.MARKS for c in at[i].reference) for i, v in votes.items()) and any(v.edits for v in votes.values())
    words = frozenset("".join(dict(zip(P.LATIN, P.THAI, strict=True)).get(c, c) for c in w) for w in ("stone", "water"))
    for x in run("KRN28_TXT28_lexical_classes"):
        want = V.lexical_classes(at[x.conv_id].reference, at[x.conv_id].second, words)
        assert all(x[f"{kind}_{c}"] == want[kind][c] for kind in want for c in V.LEXICAL)
    flips = run("KRN39_AGG36_consonant_flips")[0]
    both = [(a, b) for p in at.values() if (a := V.consonants_read(p.reference, p.output)) is not None and (b := V.consonants_read(p.reference, p.second)) is not None]
    assert (flips.found_in_both, flips.flips) == (len(both), sum(a[i] != b[i] for a, b in both for i in a))
    assert all(x.TONE_n >= x.TONE_correct and (x.conv_id % 5 != 0 or x.TONE_n == x.TONE_correct) for x in run("KRN40_site_correctness"))
    chance = {x.cell: x for x in run("PVL16_chance_found_rate")}
    for cell, x in chance.items():
        ids = sorted(i for i in at if i % 2 == cell)
        hits = [K.best_window(at[i].reference, at[j].output)[0] / len(at[i].reference) <= 0.5 for i, j in zip(ids, ids[1:] + ids[:1], strict=True) if at[i].reference]
        assert x.pairs == len(hits) and abs(x.chance_found - sum(hits) / len(hits)) < 1e-8
    assert all(x.fell_back == (x["last"] is None) for x in run("WIN17_pointed_lines"))
    loops = run("AGG27_CMP29_loop_content")[0]
    assert (loops.n, loops.reached_max, loops.exact_repeat, loops.unit_has_marks) == (22, 4, 4, 4)
    budget = run("AGG61_loops_at_budget")[0]
    assert (budget.reached_max, budget.loop_raw, budget.loop_structural_cut_tag) == (4, 0, 4)
    assert all((x.onset is not None) == (x.conv_id % 2 == 0 or x.conv_id % 5 == 4) for x in run("REP12_near_onsets"))
    assert all(x.escaped == (x.conv_id % 5 == 4) and not x.capped for x in run("REP13_stop_only"))


def test_runs_of_lines_are_settled_together(monkeypatch):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("ab c่") for _ in range(n))
    for _ in range(200):
        references, wanted = [some(r.randrange(70)) for _ in range(r.randrange(1, 6))], some(r.randrange(90))
        ends = [sorted(r.randrange(len(x) + 1) for _ in range(3)) + [len(x)] for x in references]
        assert K.prefix_costs(references, ends, wanted) == [[G.edit_distance(x[:e], wanted) for e in own] for x, own in zip(references, ends, strict=True)]
    lines, calls, plain = [some(40) + str(i) for i in range(30)], [], G.edit_distance
    text = [x for x in (" ".join(line.split()) for line in lines) if x]
    pointer = some(90)
    wanted = " ".join(pointer.split())
    runs = [(" ".join(text[i : i + n]), i, i + n) for n in range(1, 6) for i in range(len(text) - n + 1)]
    best = max((1 - plain(wanted, run) / max(len(wanted), len(run)), -len(run), -i, j) for run, i, j in runs)
    monkeypatch.setattr(G, "edit_distance", lambda *a: calls.append(a) or plain(*a))
    got = V.pointed(pointer, "\n".join(lines), least=0.0)
    assert (got["similarity"], -len(got["answer"]), -got["first"], got["last"]) == best
    assert len(calls) == 1  # one run by itself, the others in passes of many


def test_of_equally_similar_runs_the_shorter_is_found():
    # the shorter run's similarity, as a quotient of lengths, is a rounding error less than 1 less its edits
    n, size = next((n, s) for n in range(20, 200) for s in range(4 * n // 5, n - 2) if s / n < 1 - (n - s) / n)
    lines = ["a" * size + "b", "a" * size]
    got = V.pointed("a" * n, "\n".join(lines))
    assert (got["answer"], got["first"], got["last"]) == (lines[1], 1, 2) and got["similarity"] == 1 - (n - size) / n


def test_sites_of_a_long_text(spark):
    """Time grows with the text, not with its square."""
    text = "กา้ข ค\nิง" * 4_000 + "ก"
    marks = {"้": "TONE", "ิ": "UPPER", "ุ": "LOWER"}
    combining = set("ัิีึืฺุู็่้๊๋์ํ๎")
    wanted = []
    for i, c in enumerate(text):
        if c in marks:
            wanted.append((marks[c], i, c))
        elif "ก" <= c <= "ฮ" and i + 1 < len(text) and text[i + 1] not in combining:
            wanted.append(("TONE_ABSENT", i, "none"))
    spark.createDataFrame([("",)], "t string").select(X.mark_sites(F.col("t")).alias("s")).collect()
    began = time.monotonic()
    rows = spark.createDataFrame([(text,), ("",), ("ก",), ("ก้",), (None,)], "t string").select(X.mark_sites(F.col("t")).alias("s")).collect()
    assert time.monotonic() - began < 10
    assert [[tuple(s) for s in r.s] if r.s is not None else None for r in rows] == [wanted, [], [], [("TONE", 1, "้")], None]
