"""Vector codes, Drake clustering and SimHash classes against brute force."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tallyloom.llm import clustering, simhash, vector_codes
from tallyloom.llm.vectors import largest

VECTORS = "vec_id long, embedding array<float>, label int, id long, x string, code string, n int, near string, `_label` int, cluster int, unit string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 7, "x", "c", 1, "n", 3, 2, "u") for i, v, k in rows], VECTORS)


def cloud(n, width, seed, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    return [(i, (centres[i % 6] + spread * r.normal(size=width)).astype(np.float32).tolist(), i % 4) for i in range(n)]


ODD = [(9001, None, 1), (9002, [None, *[0.5] * 7], 1), (9003, [math.nan, *[0.5] * 7], 2), (9004, [math.inf, *[0.5] * 7], None), (9005, [], 1)]


def kept(rows, scale, length):
    out = [(i, [math.floor(x * scale) for x in v], k) for i, v, k in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, np.array(v, object), k) for i, v, k in out]


def means(groups, old):
    return [np.array([s // len(g) for s in sum(g)], object) if g else c for g, c in zip(groups, old, strict=True)]


def codes_by_hand(rows, parts, entries, rounds, scale, length):
    rows = kept(rows, scale, length)
    width = length // parts
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in order] for p in range(parts)]

    def assigned():
        return [[min((int(((v[p * width : (p + 1) * width] - c) ** 2).sum()), k) for k, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in rows]

    for _ in range(rounds):
        found = assigned()
        books = [means([[v[p * width : (p + 1) * width] for (_, v, _), f in zip(rows, found, strict=True) if f[p][1] == k] for k in range(len(books[p]))], books[p]) for p in range(parts)]
    found = assigned()
    error = [sum(d for d, _ in f) for f in found]
    labels = [k for _, _, k in rows]
    total = {k: sum(e for e, own in zip(error, labels, strict=True) if own == k) for k in labels}
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[own]) for (i, _, own), f, e in zip(rows, found, error, strict=True)), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries", [3, 16, 256])
def test_vector_codes(spark, entries):
    rows = cloud(60, 8, 1)
    rows += [(i + 500, [0.25] * 8, None) for i in range(20)] + [(3, rows[3][1], 3), (3, rows[5][1], 3), (None, rows[7][1], 1), (None, [1e4] * 8, 2)] + ODD
    got, books = vector_codes.compress(table(spark, rows).repartition(3), parts=4, entries=entries, rounds=4)
    want, sha = codes_by_hand(rows, 4, entries, 4, 1024, 8)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want
    assert vector_codes.books_sha256(books) == sha


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.compress(table(spark, []))[0].count() == 0
    assert vector_codes.compress(table(spark, [(1, None, 1)]))[0].count() == 0
    got, _ = vector_codes.compress(table(spark, [(1, [], 1), (2, [], 1)]))
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(table(spark, [(1, [3e38] * 8, 1)]))


def test_screening_never_loses_the_nearest():
    r = np.random.default_rng(5)
    for size in (3, 1000, 2**22, largest(16)):
        book = r.integers(-size, size, (64, 16))
        book[7], book[40] = book[3], book[3]  # ties
        x = np.concatenate([r.integers(-size, size, (300, 16)), np.repeat(book[3:4], 4, axis=0), (book[:30] + book[30:60]) // 2])
        index, distance = vector_codes.Screen(book).nearest(x)
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in x]
        assert index.tolist() == [own.index(min(own)) for own in d]
        assert distance.tolist() == [min(own) for own in d]
        if size == 2**22:  # the screen does spare work
            assert len(vector_codes.Screen(book).candidates(x)[0]) < 0.1 * x.shape[0] * 64


def clusters_by_hand(rows, k, rounds, scale, length, seed="2"):
    rows = kept(rows, scale, length)
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [r[1] for r in sorted(rows, key=lambda r: (r[0] is None, name(r[0]), list(r[1])))[:k]]
    assigned = lambda: [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids)) for _, v, _ in rows]
    for _ in range(rounds):
        found = assigned()
        centroids = means([[v for (_, v, _), f in zip(rows, found, strict=True) if f[1] == j] for j in range(len(centroids))], centroids)
    found = assigned()
    per = {j: sum(d for d, own in found if own == j) for _, j in found}
    sha = {j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest() for j in per}
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for (i, _, _), (d, j) in zip(rows, found, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (12, 3), (1, 2), (3, 0), (300, 2)])
def test_drake_clustering(spark, k, rounds):
    rows = cloud(200, 8, 2) + [(i + 900, [0.5] * 8, 1) for i in range(30)] + [(None, [0.1] * 8, 1), (5, [9.0] * 8, 1), (5, [9.0] * 8, 1)] + ODD + [(77, [1.0] * 7, 1)]
    told = []
    got = clustering.cluster(table(spark, rows).repartition(3), k=k, rounds=rounds, length=8, told=told)
    want = clusters_by_hand(rows, k, rounds, 256, 8)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()), key=str) == want
    assert [most for _, most in told[:1]] == [-(-min(k, len(want)) // 4)] * min(1, rounds)


def test_bounds_spare_distances(spark):
    told = []
    clustering.cluster(table(spark, cloud(1200, 16, 3, 0.05)), k=24, rounds=5, length=16, told=told)
    full = 1200 * 24
    assert told[0][0] == full and sum(n for n, _ in told[1:]) < 0.5 * full * 4
    assert all(3 <= most <= 6 for _, most in told)


def test_clustering_of_odd_tables(spark):
    assert clustering.cluster(table(spark, [])).count() == 0
    assert clustering.cluster(table(spark, ODD)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(table(spark, [(1, [-3e38] * 8, 1)]), length=8)


DOCS = "doc_id long, text string, fp long, unit string, least int, label string, a int, b int, side int, code long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "u", 2, "l", 3, 4, 0, 5) for i, t in rows], DOCS)


def fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes_by_hand(rows, most=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most:
            root[top(j)] = top(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, f"{f:016x}", least.get(top(k))) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["ΑΣ", "É", "<|endoftext|>"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 4, 5, 30, 200])))) for i in range(300)]
    base = r.choices(vocabulary, k=400)
    for i in range(120):  # a family of near copies
        own = list(base)
        for _ in range(r.choice([0, 1, 2])):
            own[r.randrange(400)] = "changed"
        rows.append((1000 + i, "  ".join(own)))
    rows += [(2000 + i, "Equal Text\tof five\nwords") for i in range(40)] + [(2100, "equal text of five words")]
    return rows + [(3000, None), (3001, ""), (3002, " \t\n "), (None, "a b c"), (None, "a b c"), (7, "a b c d"), (7, "a b c d"), (5000, "x " * 60_000), (5001, "y" * 200_000)]


@pytest.mark.parametrize("node", [4096, 6])
def test_simhash_classes(spark, node):
    rows = corpus()
    got = simhash.near_classes(docs(spark, rows).repartition(3), node=node).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == classes_by_hand(rows)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1, 4, 9])
def test_trie_walk_finds_all_pairs(most):
    r = np.random.default_rng(most)
    centres = r.integers(0, 2**64, 12, np.uint64)
    codes = centres[r.integers(0, 12, 900)]
    for _ in range(6):
        codes = np.where(r.random(900) < 0.5, codes ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)), codes)
    codes = np.unique(codes)
    half = len(codes) // 2
    own, other = np.array([[0, len(codes), 0, len(codes)]]), np.array([[0, half, half, len(codes)]])
    near = {(i, j) for i, j in combinations(range(len(codes)), 2) if (int(codes[i]) ^ int(codes[j])).bit_count() <= most}
    found = [(int(i), int(j)) for p, q in simhash.near_pairs(codes, own, most) for i, j in zip(p, q, strict=True)]
    assert len(found) == len(set(found)) and set(found) == near
    across = {(int(i), int(j)) for p, q in simhash.near_pairs(codes, other, most) for i, j in zip(p, q, strict=True)}
    assert across == {(i, j) for i, j in near if i < half <= j}
