"""Quality classifier: Bradley-Terry scores from preference pairs, by logistic loss on feature differences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, give_back, narrow_batches, stored, unused
from tallyloom.llm.words import chunks

#: Labelled rows that are fitted at most: those of least hash. The only bounded sample; everything else covers all rows.
FIT_ROWS = 20_000
#: Rejected rows that each preferred row is paired with, or the other way round, whichever are more.
PAIRS = 8
#: Scores from here on mean label 1.
THRESHOLD = 0.3

NAMES = ("words", "word_bytes", "upper", "symbols", "bare", "marks", "digits", "lines", "distinct", "repeated", "bigrams")

_KIND = np.zeros(256, np.uint8)  # 1 lower-case or other letters, 2 upper case, 3 digits, 4 marks, 5 other punctuation, 6 symbols
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b"!?")] = 4
_KIND[list(b".,;:'\"-()")] = 5
_KIND[(_KIND == 0) & (np.arange(256) > 32)] = 6


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, th, text): doc_id, th and the features NAMES of the text, all finite; those of an empty text are 0."""
    for b in batches:
        for c in chunks(b.column(2)):
            docs = len(c.offsets) - 1
            n = np.diff(c.words).astype(float)
            some = np.maximum(n, 1)
            of = np.repeat(np.arange(docs), np.diff(c.offsets))
            kinds = np.bincount(of * 8 + _KIND[c.data], minlength=docs * 8).reshape(docs, 8).astype(float)
            solid = np.maximum(kinds[:, 1:7].sum(axis=1), 1)
            letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
            word = c.document()
            alnum = np.concatenate([[0], np.cumsum((_KIND[c.data] >= 1) & (_KIND[c.data] <= 3))])
            bare = np.bincount(word[alnum[c.ends] == alnum[c.starts]], minlength=docs)
            h = c.hashes(True)
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (word[1:] == word[:-1])

            def distinct(v: np.ndarray, d: np.ndarray, docs: int = docs) -> np.ndarray:
                order = np.lexsort((v, d))
                v, d = v[order], d[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                return np.bincount(d[new], minlength=docs)

            follows = np.flatnonzero(word[1:] == word[:-1]) + 1
            with np.errstate(over="ignore"):
                two = h[follows] * np.uint64(3) + h[follows - 1]
            lines = np.bincount(of[c.data == 10], minlength=docs)
            out = (
                np.log1p(n), kinds[:, 1:7].sum(axis=1) / some, kinds[:, 2] / letters, kinds[:, 6] / solid, bare / some, kinds[:, 4] / some, kinds[:, 3] / solid,
                lines / some, np.log1p(distinct(h, word)) / np.log1p(some), np.bincount(word[same], minlength=docs) / some, (distinct(two, word[follows]) + 1) / some,
            )
            out = [np.where(n > 0, x, 0.0) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, docs), b.column(1).slice(c.first, docs), *map(pa.array, out)], ["doc_id", "th", *NAMES])
    give_back()


@dataclass(frozen=True)
class Model:
    """score = logistic(slope * (weights . scaled features - cut)), set so that the cut scores THRESHOLD."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float

    def score(self) -> Column:
        """Of a table of features; JVM-side."""
        parts = [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(c) - m) / s)) * w for c, m, s, w in zip(NAMES, self.mean, self.scale, self.weights, strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        odds = total - self.cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> Model:
    """Bradley-Terry: a row of label 1 is preferred to one of label 0 with chance logistic(w . difference).

    The cut is the quantile of the fitted rows' scores at the share of label 0, midway to the next row. With one label only,
    every row scores above the threshold.
    """
    dims = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(dims), np.ones(dims))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -5, 5)
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(dims)
    if not len(good) or not len(bad):
        return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), -1.0)
    r = np.random.Generator(np.random.PCG64(7))
    n = PAIRS * max(len(good), len(bad))
    diff = good[r.permutation(n) % len(good)] - bad[r.permutation(n) % len(bad)]
    velocity, rate = np.zeros(dims), 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        velocity = 0.9 * velocity + (diff.T @ p / n - ridge * w)
        w = w + rate * velocity
    u = np.sort(z @ w)
    k = len(bad)
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float((u[k - 1] + u[k]) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, th (64-bit hash of the text), held_out, score, predicted.

    Features of every whole text are made in one pass and kept; the model is fitted on the driver from at most FIT_ROWS
    labelled rows that aren't held out, and applied as an expression. Of several labels of one id the least counts.

    Nulls: a null text is empty; labels or ids that are null aren't fitted; a null id is scored and not held out. Repeated
    rows are scored each. Other columns are ignored. Empty table: no rows; no labels: every row scores above the threshold.
    """
    narrow_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).cast("string").alias("text"))
    table = stored(base.mapInArrow(features, "doc_id long, th long, " + ", ".join(f"{c} double" for c in NAMES)))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = table.join(F.broadcast(chosen), "doc_id").select("quality", *NAMES).toPandas().sort_values(list(NAMES), kind="stable")
    model = fit(rows[list(NAMES)].to_numpy(float), rows["quality"].to_numpy(float))
    score = model.score()
    return table.select("doc_id", "th", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns. Rows with a null id go or stay by their text, repeated rows together."""
    lost, lost_text = unused(docs, "_lost", "_lost_text")
    gone = stored(scored(docs, labels, id_col, text_col).where("predicted = 0").select(F.col("doc_id").alias(lost), F.col("th").alias(lost_text)).distinct())
    same = F.col(id_col).cast("long").eqNullSafe(F.col(lost)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(lost_text))
    return docs.join(broadcast_if_small(gone, gone.count()), same, "left_anti")
