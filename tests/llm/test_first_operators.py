"""Exact dedup, sharding and packing against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string, shard string, kept string, start string"
LONG = "wörd Σίσυφος don't <|endoftext|> " * 4000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, "y", None) for i, t in rows], DOCS)


ROWS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (7, None), (8, ""), (8, ""), (2, "x y"), (None, "a b"), (None, "z"), (None, "z"), (1, LONG), (4, LONG), (6, "ab"), (6, "cd")]


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    key = lambda t: min((i for i in groups[t] if i is not None), default=None)
    return sorted(((i, key(t), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    extra = {"content_hash": lambda t: F.substring(F.unhex(F.md5(t.cast("binary"))), 1, 0)} if weak else {}  # one hash for all texts
    got = exact_dedup.exact_groups(docs(spark, ROWS), **extra).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_clashing_names(spark):
    from tallyloom.llm import jaccard, mixing, quality

    names = ["_id", "_id0", "_sha", "_sha0", "_lost", "_LOST_", "_lost_sha", "_own", "_own_sha", "_chance", "_own_lang", "_cell_lang", "_gone", "_th"]
    more = docs(spark, ROWS).withColumns({c: F.lit(k) for k, c in enumerate(names)})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for keep in (exact_dedup.drop_exact_copies, jaccard.keep_one_of_each, mixing.sample, lambda d: quality.keep_good(d, labels)):
        plain = sorted(((r.doc_id, r.text) for r in keep(docs(spark, ROWS)).collect()), key=str)
        got = keep(more)
        assert got.columns == more.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == plain


def test_drop_exact_copies(spark):
    got = exact_dedup.drop_exact_copies(docs(spark, ROWS))
    assert got.columns == docs(spark, ROWS).columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(1, LONG), (2, "x y"), (3, "a b"), (6, "ab"), (6, "cd"), (7, None)]
    assert got.where("doc_id is null").count() == 1


def test_empty(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0
    assert sharding.assign_shards(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sharding(spark):
    rows = [(i, f"text {i % 700} " + "w " * (i % 90)) for i in range(2000)] + [(5000 + i, "hot " * 40) for i in range(1500)] + ROWS
    got = sharding.assign_shards(docs(spark, rows), 16).toPandas()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], got["text_crc32"], strict=True)) == sorted((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    # a group over a shard's capacity is cut, any other lies in one shard
    by = got.groupby("text_crc32")["shard"].nunique()
    hot = zlib.crc32(b"hot " * 40)
    assert by.drop([hot, zlib.crc32(LONG.encode())]).max() == 1
    assert by[hot] > 1


def test_sharding_is_near_equal(spark):
    rows = [(i, f"{i} " + "word " * (i * 7919 % 400)) for i in range(4000)]
    bytes_ = sharding.assign_shards(docs(spark, rows), 16).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(bytes_) == 16 and bytes_.max() - bytes_.min() < 0.02 * bytes_.mean()


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, f"number {i} " + "some wörds, ΑΣ Σ. it's " * (i * 31 % 300)) for i in range(1, 400)] + [(i, t) for i, t in ROWS if i is not None and i not in range(1, 400)] + [(1000, LONG), (1001, None), (1002, "x" * 5000)]
    got = packing.pack(docs(spark, rows).repartition(5), path).toPandas().astype("int64")
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = got[got["doc_id"] == i].sort_values("start")
        assert own["doc_tokens"].unique() == [len(ids)]
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.length > 0
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() * 2048 < 1.01 * got["length"].sum() + 2 * 2048


def test_packing_leaves_no_words_with_its_workers(spark):
    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(w.old) + len(w.new) for w in packing._cached.values())], pa.int64())], ["id"])

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200))) for i in range(200)]
    assert packing.pack(docs(spark, rows).repartition(4), public_tokenizers.path("word_bpe_49k.json")).count() >= 200
    assert {r.id for r in spark.range(0, 64, 1, 8).mapInArrow(held, "id long").collect()} == {0}


def test_packing_tokenizes_few_words_at_a_time():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, sizes = packing.WordIds(path), []
    real = words.tokenizer

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, **options)

    words.tokenizer = Watched()
    texts = [f"wörd{k * 7919}" for k in range(9001)]
    at = words.slots(np.arange(9001, dtype=np.uint64), lambda k: texts[k].encode())
    assert max(sizes) <= 2000
    for k in (0, 1999, 2000, 2001, 5999, 6000, 9000):
        assert words.ids[words.at[at[k]] : words.at[at[k] + 1]].tolist() == real.encode(texts[k], add_special_tokens=False).ids
