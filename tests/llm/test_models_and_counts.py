"""Mixing, nearest neighbours, quality, token counts and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import ann, mixing, quality, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1.0, 5) for i, t, lang, s in rows], DOCS).repartition(3)


def corpus(n=240):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        t = " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 200)))
        bad = i % 6 == 0
        if bad:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, ("en", "de", None)[i % 3], "big" if i % 2 else f"s{i % 5}"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_raking_meets_the_marginals(spark):
    rows, _ = corpus()
    got = mixing.with_chances(docs(spark, rows), keep=0.6, power=0.5).toPandas()
    all_ = got["tokens"].sum()
    for d in ("source", "lang", "topic"):
        want = np.sqrt(got.groupby(d)["tokens"].sum())
        have = (got["tokens"] * got["weight"]).groupby(got[d]).sum() / all_
        assert np.allclose(have, want / want.sum(), atol=1e-6)
    assert abs((got["tokens"] * got["chance"]).sum() / all_ - 0.6) < 1e-6
    kept = mixing.sample(docs(spark, rows), keep=0.6, power=0.5)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got.loc[got["sampled"], "doc_id"])


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "a b", "en", "s"), (2, "", "en", "s")]
    assert mixing.with_chances(docs(spark, rows)).count() == 4
    assert mixing.with_chances(docs(spark, [])).count() == mixing.sample(docs(spark, [])).count() == 0


def neighbours(spark, rows, **k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, entry long").repartition(3)
    out = defaultdict(list)
    for r in ann.nearest(df, **k).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 16)).astype(np.float32)
    x[300:420] = x[7]  # copies
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]], 1, 2) for i in range(900)]
    odd = [(1000, None, 1, 2), (1050, [0.0] * 16, 1, 2), (1100, [float("nan")] + [1.0] * 15, 1, 2), (1150, [1.0] * 3, 1, 2), (None, [1.0] * 16, 1, 2), (1200, [None] + [1.0] * 15, 1, 2)]
    exact = neighbours(spark, rows + odd + rows[:3], share=1.0)
    assert set(exact) == set(range(0, 900, 50))
    for q, found in exact.items():
        s = u @ u[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [i for i, _ in found] == order
        assert np.allclose([v for _, v in found], s[order], atol=1e-12)
    near = neighbours(spark, rows, share=0.6, least=1)
    hits = sum(len({i for i, _ in exact[q]} & {i for i, _ in near[q]}) for q in exact)
    assert hits >= 0.9 * 5 * len(exact)
    assert not neighbours(spark, odd[:2]) and not neighbours(spark, [])
    assert [i for i, _ in neighbours(spark, [(0, [1.0, 2.0], 1, 1), (3, [2.0, 1.0], 1, 1)])[0]] == [3]


def test_neighbours_of_one_direction(spark):
    copies = [(i, [2.0 ** (i * 7 % 41 - 20), 2.0 ** (i * 7 % 41 - 20), 0.0], 1, 2) for i in range(1, 41)]  # scores are equal
    found = neighbours(spark, [*copies, (100, [1.0, 0.5, 0.25], 1, 2), (150, [0.0, 0.0, -1.0], 1, 2)], share=1.0)
    assert [i for i, _ in found[100]] == [1, 2, 3, 4, 5]
    single = neighbours(spark, [(0, [2.0], 1, 2), (1, [-1.0], 1, 2), (2, [3.0], 1, 2), (3, [5.0], 1, 2)], k=2, share=1.0)
    assert [(i, round(v, 12)) for i, v in single[0]] == [(2, 1.0), (3, 1.0)]


def test_quality(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    odd = [(None, "fine words in a row", "en", "s"), (5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "x" * 300_000, "en", "s")]
    got = quality.scored(docs(spark, rows + odd), table).toPandas()
    assert len(got) == len(rows) + 4 and got["score"].between(0, 1).all()
    known = got.merge(spark.createDataFrame(labels, "doc_id long, quality int").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert (known["held_out"] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known["doc_id"]]).all()
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    kept = quality.keep_good(docs(spark, rows), table)
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == int(known["predicted"].sum())
    assert quality.scored(docs(spark, []), table).count() == 0
    assert quality.scored(docs(spark, rows[:5]), table.limit(0)).where("predicted = 1").count() == 5


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter = token_counts.Counter(path, public_tokenizers.PATTERN)
    r = random.Random(3)
    parts = ["a", "b's", "'ll", " ", "  ", "\n", "\n\n", "12", "é", "!?", "word", "\t", " x", "'", "一"]
    text = lambda n: "".join(r.choice(parts) for _ in range(n))
    for _ in range(150):
        now = text(r.choice([0, 1, 5, 40, 900]))
        tree = token_counts.Tree(now, counter)
        for _ in range(5):
            s = r.randrange(len(now) + 2)
            e, put = s + r.choice([0, 1, 3, 20, len(now)]), text(r.choice([0, 1, 3, 30]))
            tree.edit(s, e, put)
            s = min(s, len(now))
            now = now[:s] + put + now[min(max(e, s), len(now)) :]
            pieces = counter.pattern.findall(now)
            assert [x for a, _ in tree.leaves for x in a] == list(map(len, pieces))
            assert tree.totals == (len(now), len(pieces), len(counter.encoding.encode_ordinary(now)))
    long = token_counts.Tree("some words " * 20_000, counter)
    long.edit(100_000, 100_003, "new")
    assert long.reencoded < 12
    rows = [(1, "some text here " * 30, "en", "s"), (None, None, None, None), (2, "", "en", "s"), (2, "", "en", "s")]
    got = token_counts.count_with_edits(docs(spark, rows), token_counts.drill, path, public_tokenizers.PATTERN).toPandas()
    assert len(got) == 4 and (got["n_tokens_after"] > 0).all()
    assert token_counts.count_with_edits(docs(spark, []), token_counts.drill, path, public_tokenizers.PATTERN).count() == 0


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(120)
    rows += [(1000 + i, rows[7][1], "en", "big") for i in range(5)] + [(2000 + i, rows[9][1] + f" tail{i}", "en", "big") for i in range(3)]
    spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = at.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids.append({r.doc_id for r in at.select("doc_id").distinct().collect()})
        assert k == 4 or at.columns == columns
    bad = {i for i, q in labels if q == 0}
    assert not ids[0] & bad
    assert not ids[1] & set(range(1000, 1005)) and ids[1] == ids[0] - set(range(1000, 1005))
    assert ids[2] == ids[1] - set(range(2000, 2003))
    assert ids[3] < ids[2] and ids[4] == ids[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, at.collect()))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, ids that repeat or are missing, empty and very long texts, columns of other names; then no rows at all."""
    rows, labels = corpus(60)
    kind = "doc_id long, text string, lang string, source string, n_chars long, fp string, `_lost` int, label string"
    odd = [(500, None, None, None), (501, "", None, "big"), (502, " \n ", "en", None), (None, rows[1][1], "en", "big"), (None, None, None, None), (3, rows[3][1], "en", "big"), (3, rows[4][1], "en", "big"), (503, "word " * 60_000, "en", "big"), (504, "x" * 300_000, None, "s1")]
    table = [(i, t, lang, s, None, "f", 7, None) for i, t, lang, s in rows + odd]
    spark.createDataFrame(table, kind).write.parquet(str(tmp_path / "a/documents.parquet"))
    marks = spark.createDataFrame([*labels, (None, 1), (500, None)], "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int"))
    marks.write.parquet(str(tmp_path / "a/labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).toPandas()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and len(got) > 20
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "b/documents.parquet"))
    marks.write.parquet(str(tmp_path / "b/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_a_pipeline_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    rows, labels = corpus(30)
    spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    folder = Path(corpus_pipeline.shared_dir(spark)) / "tallyloom"
    before = set(folder.glob("pipeline-*"))

    def broken(spark, docs, sf_dir):
        raise RuntimeError("stopped here")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError, match="stopped here"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert set(folder.glob("pipeline-*")) == before
