"""Kernels against plain definitions."""

import random

import pytest

from tallyloom.functions import kernels as K
from tallyloom.functions import markup as M
from tallyloom.functions import reading as G
from tallyloom.operators import relational as R
from tallyloom.plans import comparisons, reading

CASES = [("", ""), ("", "abc"), ("abc", ""), ("kitten", "sitting"), ("ไฟฟ้า น้ำ", "ไฟฟา น้ำ"), ("aaaa", "aa")]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some(seed, n, letters="abก้"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(n)]


def test_alignment_costs_the_edit_distance():
    pairs = CASES + list(zip(some(1, 200), some(2, 200), strict=True))
    for a, b in pairs:
        p = K.align(a, b)
        assert K.distance(p, a, b) == plain(a, b)
        assert [i for i, _ in p if i is not None] == list(range(len(a))) and [j for _, j in p if j is not None] == list(range(len(b)))
        assert sum(K.component_errors(a, b).values()) == plain(a, b)
        assert len(K.fates(p, a, b)) == len(a)


def test_anchored_and_window():
    for a, b in zip(some(3, 150), some(4, 150), strict=True):
        best = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        p, start, end = K.align_anchored(a, b)
        assert K.distance(p, a, b) == (best if a else 0)
        assert plain(a, b[start:end]) == (best if a else 0)
        if a:
            d, start, end = K.best_window(a, b)
            ends = [j for j in range(len(b) + 1) if min(plain(a, b[i:j]) for i in range(j + 1)) == best]
            assert (d, end) == (best, ends[0])
            assert start == max(i for i in range(end + 1) if plain(a, b[i:end]) == best)


def test_marks():
    m = K.mark_counts("ไฟฟ้า น้ำ", "ไฟฟา น้ำ")
    assert (m["TONE_n"], m["TONE_deleted"], m["TONE_correct"], m["TONE_base_n"], m["TONE_base_error"]) == (2, 1, 1, 2, 1)


@pytest.mark.parametrize(("text", "want"), [("intro " + "abcd" * 9, (6, 4)), ("1234" * 20, None), ("no loop here", None), ("", None)])
def test_loop_onset(text, want):
    got = K.loop_onset(text, 8, 6)
    assert got == want


def test_loops():
    t = "start " + "x" * 3 + "a sentence of some length. " * 5
    period, start = K.loop_period(t)
    assert period == 27 and t[start : start + 27] * 2 == t[start : start + 54]
    assert K.strip_repeats("ab12" * 10 + "end") == "ab12end"
    assert K.cut_at_loop("ab12" * 10 + "end", 8, 6) == "ab12"
    assert K.strip_repeats("q" + "ab12" * 9 + " - " + "word " * 12 + "abc") == "qab12 - word abc"
    assert K.loop_onset("x" + (" " * 32 + "a") * 9, 8, 6) == (2, 33)  # at 1 the shortest unit is of spaces
    assert K.loop_onset("-" * 500, 8, 6) is None


def test_markup_rules():
    assert M.extract("<section>ab</section><section>cd</section><caption>x</caption>e<figure/>f") == ("ab cd x e f", 0, 0)
    assert M.extract("a<figure>b<figure>c</figure>d</figure>e</figure>f<figure>g") == ("a e f", 3, 1)
    assert M.extract("a<figure>b</figure>c", figures=True) == ("a b c", 1, 0)
    assert M.unwrap(r'{"natural_text": "a\nb", "x": tr') == "a\nb" and M.unwrap(r'{"natural_text": "a\u00e9\u12') == "aé"
    assert M.unwrap('{"natural_text": null}') == '{"natural_text": null}' and M.unwrap('{"natural_text": "a\nb"') == "a\nb" and M.unwrap("x") == "x"
    assert M.windows("  ab cd  efg h", 4) == [(2, 7), (9, 14)] and M.windows(" ", 4) == [] and M.windows("ab cd e", 4) == [(0, 7)]


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 5.0, 5.0)], "id int, x double, y double")
    near = spark.createDataFrame([(7, 1.0, 0.0), (3, 0.0, 1.0), (9, 5.0, 4.0)], "ordinal int, rx double, ry double")
    assert sorted((r.id, r.nearest) for r in R.nearest_representative(rows, near, "x", "y").collect()) == [(1, 3), (1, 3), (2, 9)]
    arms = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 1)], "item int, arm string, v int")
    assert [tuple(r) for r in R.paired(arms, "item", "arm", "a", "b", ["v"]).collect()] == [(1, 5, 6)]
    with pytest.raises(Exception, match="two rows of one arm"):
        R.paired(arms.unionByName(arms), "item", "arm", "a", "b", ["v"]).collect()
    assert K.banned_tokens([1, 2, 3, 1, 2], 3, 10) == [3] and K.banned_tokens([1, 2, 3, 1, 2], 3, 10, frozenset([3])) == []


def test_long_texts_are_aligned(spark):
    r = random.Random(6)
    a = "".join(r.choice("abก่") for _ in range(2100))
    b = "".join(c for c in a if r.random() > 0.02) + "b"
    t = spark.createDataFrame([(a, b, "cc" + a + "cc")], "a string, b string, c string")
    got = t.select(K.component_errors_udf()("a", "b").alias("e"), K.mark_counts_udf()("a", "b").alias("m"), K.anchored_udf()("a", "c").alias("x"), K.window_udf()("a", "c").alias("w")).first()
    assert sum(got.e) == plain(a, b) and None not in got.m
    assert tuple(got.x) == tuple(got.w) == (0, 2, 2102)


@pytest.mark.parametrize("cells", [0, 40])
def test_rows_made_again_give_the_same_alignment(monkeypatch, cells):
    pairs = CASES + list(zip(some(7, 200), some(8, 200), strict=True))
    whole = [(K.align(a, b), K.align_anchored(a, b), K.best_window(a, b)) for a, b in pairs]
    monkeypatch.setattr(K, "MOST_CELLS", cells)
    assert [(K.align(a, b), K.align_anchored(a, b), K.best_window(a, b)) for a, b in pairs] == whole


def test_lines_are_found_in_one_pass(monkeypatch):
    lines, text = [t for t in some(9, 60) if t], "".join(some(10, 60))
    want = []
    for line in lines:
        costs = [min(plain(line, text[i:j]) for i in range(j + 1)) for j in range(len(text[:40]) + 1)]
        want.append((costs.index(min(costs)), min(costs)))
    for size in (50, 4 << 20):
        monkeypatch.setattr(K, "BLOCK_BYTES", size)
        assert [(end, best) for _, end, best in K.reaches(lines, text[:40])] == want


def test_equal_ends_and_parts_need_no_matrix(monkeypatch):
    monkeypatch.setattr(K, "EditMatrix", None)
    a = "abcab" * 20_000
    assert [j for _, j in K.align(a, a.replace("c", ""))].count(None) == 20_000
    assert [i for i, _ in K.align(a[:50_000], a)].count(None) == 50_000


def test_units_that_may_loop_are_few():
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 23) for i in range(3000))
    assert len(K._units(K._codes(text), 4, 49, 28)) < 46 and 11 in K._units(K._codes(text + " over again" * 30), 4, 49, 28)

def no_matrix(*_):
    raise AssertionError("an edit matrix where none is needed")


def test_replaced_characters_need_no_matrix(monkeypatch):
    monkeypatch.setattr(K, "_Columns", no_matrix)
    a = "bacd ef " * 300
    b = a.replace("a", "z")
    assert K.align(a, b) == [(i, i) for i in range(len(a))]
    assert G.edit_distance(a, b) == 300 and K.best_window(a, b) == (300, 0, len(a))
    assert K.best_window(a, a.replace("c", "")) == (300, 0, len(a) - 300) and K.best_window("cd e", a) == (0, 2, 6)
    assert K.align_anchored("abcd efg", "xabcd efg" * 2) == ([(i, i + 1) for i in range(8)], 1, 9)


def test_lines_are_found_around_their_pieces(monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    lines = [" ".join(words[i : i + 30]) for i in range(0, 900, 30)]
    output = "\n".join(lines).replace("a", "e")
    want = []
    for line in lines:
        costs = K.bit_costs(K._codes(line), K._codes(output), free_start=True)
        want.append((max(0, costs.index(min(costs)) - len(line) - min(costs)), costs.index(min(costs)), min(costs)))
    passed, whole = [], K.bit_costs
    monkeypatch.setattr(K, "bit_costs", lambda a, b, free_start=False: (passed.append(len(b)), whole(a, b, free_start))[1])
    assert K.reaches(lines, output) == want and sum(passed) < 4 * len(output)


def test_units_that_stand_twice_are_no_runs():
    draw = random.Random(6)
    text = "".join(draw.choice(["th", "er", "on", "an", "ing ", "tion"]) for _ in range(8000))
    assert K._units(K._codes(text), 50, 400, 6) == [] and K.loop_onset(text, 8, 6) is None
    assert K.loop_onset(text + "over again " * 9, 8, 6) == (len(text), 11)


def test_equal_outputs_of_arms_are_aligned_once(monkeypatch):
    asked, align = [], K.align
    monkeypatch.setattr(K, "align", lambda a, b: (asked.append(b), align(a, b))[1])
    assert comparisons.score("กาขา\nคา", "คา\nกาขา") == comparisons.score("กาขา\nคา", "คา\nกาขา")
    assert asked.count("คา\nกาขา") == 1
    monkeypatch.setattr(G, "edit_distance", lambda a, b: asked.append((a, b)) or 7)
    assert reading.three_distances("ab", "c", "ab", "c", "c") == {"e": 7, "es": 7, "ed": 7} and asked.count(("ab", "c")) == 1


def test_many_distances():
    r = random.Random(21)
    text = lambda letters: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 7, 63, 64, 65, 128, 129, r.randrange(300)])))
    pairs = [(text(x), text(x)) for x in ("ab", "abc ก่", "aé\U0001f600\0ก") for _ in range(150)] + [("same", "same"), ("a", "b" * 3000), ("x" * 1500, "xy" * 600)]
    alone = []
    got = K.many_distances(pairs, lambda a, b: alone.append((a, b)) or plain(a, b))
    assert got == [plain(a, b) for a, b in pairs]
    assert ("x" * 1500, "xy" * 600) in alone and len(alone) < len(pairs) / 2  # most stand side by side
    assert K.many_distances([], plain) == []
