"""Jaccard classes, substring and suffix dedup against brute force, on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import jaccard, regions, substring, suffix
from tallyloom.llm.components import components

DOCS = "doc_id long, text string, key long, n long, fp string, label string, h long, m long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, None, "x", "y", 2, 3) for i, t in rows], DOCS).repartition(3)


def words(t, lower=False):
    t = t or ""
    if lower:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def corpus(seed, n, vocabulary=400):
    r = random.Random(seed)
    text = lambda k: " ".join(f"w{r.randrange(vocabulary)}é" for _ in range(k))
    passage, line = text(60), text(9)
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        t = text(r.randrange(1, 150))
        if kind == 0 and rows:
            t = r.choice(rows)[1] or ""
            w = t.split(" ")
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            t = " ".join(w)
        elif kind == 1:
            t += " " + passage + "\t" + text(r.randrange(30))
        elif kind == 2:
            t = line + "\n" + t
        elif kind == 3:
            t = " ".join(["again"] * r.randrange(1, 90)) + "  " + t
        rows.append((i, t))
    hot = text(120).split(" ")
    for i in range(n, n + n // 2):  # near copies of one text
        w = list(hot)
        for _ in range(i % 3):
            w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n * 9, None), (n * 9 + 1, ""), (n * 9 + 2, " \n"), (n * 9 + 3, "A b"), (n * 9 + 4, "a B"), (n * 9 + 5, passage * 200)]


def expected_classes(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 10**12), k)
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "num", "frequent"), [(3, 90, 32), (5, 80, 4), (2, 60, 2)])
def test_classes(spark, width, num, frequent):
    rows = corpus(width, 150, 60 if width == 2 else 400)
    got = jaccard.classes(docs(spark, rows), width, num, 100, frequent=frequent)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == expected_classes(rows, width, num, 100)


def test_classes_of_pairs_with_appended_text(spark):
    r, rows, new = random.Random(8), [], iter(range(10**9))
    for i in range(0, 600, 2):  # isolated pairs, of J from just below the threshold to 0.85
        w = [f"t{next(new)}" for _ in range(r.randrange(60, 300))]
        more = [f"t{next(new)}" for _ in range(int((len(w) - 4) * (100 / r.uniform(79.5, 85) - 1)))]
        at = r.choice([0, len(w), len(w)])
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:at] + more + w[at:]))]
    want = expected_classes(rows, 5, 80, 100)
    assert sum(k != c for k, _, c in want) > 200
    got = jaccard.classes(docs(spark, rows), 5, 80, 100)
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_classes_by_parts(spark):
    rows = near_copies_for_parts()
    whole = sorted(tuple(r) for r in jaccard.classes(docs(spark, rows), 3, 60, 100).collect())
    assert sorted(tuple(r) for r in jaccard.classes(docs(spark, rows), 3, 60, 100, posts=7).collect()) == whole == expected_classes(rows, 3, 60, 100)
    schema = "fp binary, n long, odd int, sigs array<long>"
    nodes = spark.createDataFrame([(bytes([k]), 9, 9, [1, 2, 3, 10 + k]) for k in range(9)], schema)
    met = jaccard.lists_by_parts(nodes, 60, 100, 6)
    assert len(met._parts) == 6 and sorted((r.sig, r.c) for r in met.collect()) == sorted((s, 9) for s in (1, 2, 3) for _ in range(9))


def test_parts_make_each_signature_a_row_once(spark):
    nodes = spark.createDataFrame([(bytes([k]), 9, 2, [-1, 2, 3, 10 + k, -7]) for k in range(9)], "fp binary, n long, odd int, sigs array<long>")

    def made(plan) -> int:
        own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName().startswith("Generate") else 0
        return own + sum(made(plan.children().apply(i)) for i in range(plan.children().size()))

    rows, found = 0, []
    for k in range(4):
        df = jaccard.posted(nodes, 90, 100, 4, k)
        query = df._jdf.queryExecution()
        query.executedPlan().executeCollect()
        rows += made(query.executedPlan())
        found += [(r.sig, r.rare) for r in df.collect()]
    assert rows == 45
    assert sorted(found) == sorted(p for k in range(9) for p in ((-1, True), (2, True), (3, False), (10 + k, False), (-7, False)))


def near_copies_for_parts():
    draw = random.Random(12)
    base = [[draw.choice("abcdefgh") * 2 for _ in range(30)] for _ in range(6)]
    return [(k, " ".join(base[k % 6][: 30 - k % 5])) for k in range(30)]


@pytest.mark.parametrize(("short", "rounds"), [(2, 0), (3, 5)])
def test_classes_of_families(spark, short, rounds):
    r, rows = random.Random(short + rounds), []
    word = lambda: f"f{r.randrange(10**7)}"
    for f in range(4):  # families of near copies: edits from a base, and from versions of it with another passage
        base = [word() for _ in range(120)]
        versions = [base, base[:30] + [word() for _ in range(25)] + base[55:], base[:80] + [word() for _ in range(25)] + base[105:]]
        for i in range(45):
            w = list(versions[i % 3])
            for _ in range(r.randrange(5)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = [r.choice([word(), f"e{r.randrange(5)}"])] * r.randrange(3)
            rows.append((1000 * f + i, " ".join(w)))
    want = expected_classes(rows, 3, 90, 100)
    got = jaccard.classes(docs(spark, rows), 3, 90, 100, frequent=4, short=short, rounds=rounds)
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == want
    assert 20 < len({c for _, _, c in want}) < 170


def test_pairs_of_differences():
    """Sets of one size link as their differences to a pivot tell."""
    r = random.Random(4)
    pivot = set(range(100))
    for _ in range(2000):
        x, y = ((pivot - set(r.sample(range(100), r.randrange(9)))) | set(r.sample(range(100, 112), r.randrange(9))) for _ in range(2))
        dx, dy = x ^ pivot, y ^ pivot
        assert (len(x & y) * 100 >= len(x | y) * 90) == (len(dx) * 190 - len(x) * 10 + len(dy) * 190 - len(y) * 10 <= 380 * len(dx & dy))


def test_classes_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (None, None), (7, "x"), (3, "X")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (None, None), (7, 3), (3, 3)], key=str)
    kept = jaccard.keep_one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "a b c d e f")] * 2 + [("3", "X"), ("None", "None"), ("None", "a b c d e f"), ("None", "q r s t u")]
    assert jaccard.classes(docs(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 40)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    got = {x.a: x.b for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        assert got.get(x, x) == min(seen)


def expected_words(rows, n):
    seen, out = set(), []
    for k, t in sorted(rows):
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if (x := tuple(w[i : i + n])) in seen:
                gone.update(range(i, i + n))
            seen.add(x)
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(spark, window):
    rows = corpus(window, 150, 12 if window == 7 else 400)
    got = substring.dedup_substrings(docs(spark, rows), window, digest=True)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == expected_words(rows, window)


def test_substrings_of_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(30))
    rows = [(2, t), (None, t + " end"), (2, t), (None, None), (1, "other " + t)]
    got = substring.dedup_substrings(docs(spark, rows), 20).collect()
    assert sorted(((r.doc_id, r.n_removed, r.kept) for r in got), key=str) == sorted([(1, 0, "other " + t), (2, 30, ""), (2, 30, ""), (None, 30, "end"), (None, 0, "")], key=str)
    assert substring.dedup_substrings(docs(spark, [])).count() == 0


def test_substrings_of_hot_grams(spark, monkeypatch):
    """Grams named at more than a few places are dealt window by window."""
    monkeypatch.setattr(regions, "HOT", {False: 3, True: 3})
    rows = corpus(20, 150)
    got = substring.dedup_substrings(docs(spark, rows), 20, digest=True)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == expected_words(rows, 20)


def test_grams_have_64_bits():
    import numpy as np

    from tallyloom.llm.words import BYTES

    data = np.random.default_rng(1).integers(0, 256, 400_000, np.uint8)
    grams = regions.gram_values(BYTES[data], 16)
    assert grams.dtype == np.uint64 and grams.min() > 0 and len(np.unique(grams)) == len(grams)
    assert abs((grams & np.uint64(1)).mean() - 0.5) < 0.01 and abs((grams >> np.uint64(63)).mean() - 0.5) < 0.01


@pytest.mark.parametrize(("hot", "part", "run"), [(100_000, 20_000, 50_000), (3, 5, 7), (100_000, 4, 3)])
def test_suffixes(spark, monkeypatch, hot, part, run):
    monkeypatch.setattr(regions, "HOT", {False: hot, True: hot})
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "RUN", run)
    rows = corpus(3, 120)
    texts = {k: (t or "").encode() for k, t in rows}
    at = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    want = []
    for k, t in sorted(texts.items()):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if at[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((k, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(left).hexdigest()))
    got = suffix.dedup_suffixes(docs(spark, rows), digest=True)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    odd = suffix.dedup_suffixes(docs(spark, [(1, "ab" * 200), (1, "ab" * 200), (None, None), (None, "abc")]))
    assert sorted(((r.doc_id, r.n_removed, bytes(r.kept)) for r in odd.collect()), key=str) == sorted([(1, 400, b""), (1, 400, b""), (None, 0, b""), (None, 0, b"abc")], key=str)
    assert suffix.dedup_suffixes(docs(spark, [])).count() == 0


def test_merge_keeps_common_prefixes():
    r = random.Random(2)
    text = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    records = sorted((text(r.randrange(40)), text(5), bytes(16), 1) for _ in range(500))
    out = list(suffix.merge([suffix.decoded(list(suffix.front_coded(records[i::7]))) for i in range(7)]))
    assert [x[1] for x in out] == [x[0] for x in records]
    assert all(b[0] == suffix.common_prefix(a[1], b[1]) for a, b in zip(out, out[1:], strict=False))


def test_regions_of_one_gram_are_not_held_against_each_other(monkeypatch):
    r = random.Random(5)
    some = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    window, gram, ends = 40, b"G" * 8, [some(32) for _ in range(6)]
    regions_ = sorted({(m.to_bytes(8, "big") + gram + (r.choice(ends)[: r.randrange(33)] + some(32))[:32], (r.choice(ends)[: r.randrange(33)] + some(32))[:32]) for m in (1, 2) for _ in range(600)})
    last, records = b"", []
    for k, (suffix_, left) in enumerate(regions_):
        records.append((suffix.common_prefix(last, suffix_), suffix_, left, k.to_bytes(16, "big"), 1))
        last = suffix_
    at = defaultdict(set)
    for k, (suffix_, left) in enumerate(regions_):
        text = left[::-1] + suffix_[8:]
        for i in range(len(text) - window + 1):
            at[suffix_[:8], len(left) - i, text[i : i + window]].add((k, i))
    want = set().union(*(x for x in at.values() if len(x) > 1))
    calls, plain = [], suffix.common_prefix
    monkeypatch.setattr(suffix, "common_prefix", lambda *a: calls.append(a) or plain(*a))
    found = list(suffix.covered(records, window))
    got = [(int.from_bytes(tid, "big"), i) for tid, first, end in found for i in range(first, end + 1)]
    assert set(got) == want and len(got) == len(want) and len(want) > 600
    assert len(calls) <= len(records)  # once for each pair of neighbours
