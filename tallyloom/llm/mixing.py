"""Mixing sources to target weights: token weights are raked to marginals, and documents sampled by the calibrated chances.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_ROWS, stored, unused

#: Sweeps over all marginals between two looks at how far they are off, and such looks at most.
SWEEPS, LOOKS = 6, 10
#: Cells (combinations of categories) at most; they are raked in one task.
MOST_CELLS = 1_000_000
#: Fixed value: names of the length classes that stand for topics where documents have none, and the words they begin at.
TOPICS = (("note", 0), ("article", 100), ("report", 400), ("book", 2000))


def tokens(text: Column) -> Column:
    """White-space words, and one for the end of the document."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long") + 1


def topic_by_length(n: Column) -> Column:
    out = F.lit(TOPICS[0][0])
    for name, least in TOPICS[1:]:
        out = F.when(n >= least, name).otherwise(out)
    return out


def unit(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that is fixed by the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension's categories: their shares to a power, scaled to 1."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).select(dim, F.pow(F.col("t").cast("double"), F.lit(power)).alias("t"))
    every = own.agg(F.sum("t")).first()[0] or 1.0
    return own.select(dim, (F.col("t") / every).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9) -> DataFrame:
    """Iterative proportional fitting. cells: the dimensions and tokens; targets: of each dimension, its categories and their shares.

    Adds weight: what a cell's token counts for, so that weighted tokens have the target shares in every dimension and sum to
    all tokens. Categories without target get weight 0; targets of categories without tokens are spread over the others.
    The cells, bounded by the categories and not by the rows, are held in one partition, so that the windows of all sweeps
    need no exchange.
    """
    every = cells.agg(F.sum("tokens")).first()[0] or 0
    at = cells.withColumn("weight", F.lit(1.0))
    for dim, target in targets.items():
        at = at.join(F.broadcast(target.withColumnRenamed("target", f"_t_{dim}")), dim, "left")
    at = stored(at.fillna(0.0, [f"_t_{d}" for d in targets]))
    if at.count() > MOST_CELLS:
        raise ValueError("too many cells to rake")
    mass = F.col("tokens") * F.col("weight")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    for _ in range(LOOKS):
        at = at.coalesce(1)
        for _ in range(SWEEPS):
            for dim in targets:
                have = F.sum(mass).over(Window.partitionBy(dim).orderBy(*targets).rowsBetween(*whole))
                at = at.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"_t_{dim}") * every / have).otherwise(0.0))
            got = F.sum(mass).over(Window.orderBy(*targets).rowsBetween(*whole))  # shares of categories without mass go to the rest
            at = at.withColumn("weight", F.when(got > 0, F.col("weight") * every / got).otherwise(0.0))
        at = stored(at)
        off = [at.groupBy(d).agg(F.abs(F.sum(mass) / every - F.first(f"_t_{d}")).alias("off")).agg(F.max("off")) for d in targets]
        worst = off[0]
        for x in off[1:]:
            worst = worst.unionByName(x)
        if (worst.agg(F.max("max(off)")).first()[0] or 0.0) < tolerance:
            break
    else:
        warnings.warn(f"raked weights are still more than {tolerance} off some target: the targets may exclude each other", stacklevel=2)
    return at.select(*targets, "tokens", "weight")


def calibrated(cells: DataFrame, keep: float, steps: int = 90) -> DataFrame:
    """Adds chance = min(1, rate * weight), with the rate at which the expected tokens are `keep` of all, found by halving."""
    expected = lambda rate: F.aggregate("held", F.lit(0.0), lambda s, c: s + c["tokens"] * F.least(F.lit(1.0), c["weight"] * rate))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        less = expected(mid) < F.col("every") * keep
        return F.struct(F.when(less, mid).otherwise(s["lo"]).alias("lo"), F.when(less, s["hi"]).otherwise(mid).alias("hi"))

    one = cells.agg(F.sort_array(F.collect_list(F.struct("tokens", "weight"))).alias("held"), F.sum("tokens").alias("every"))
    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1e9).alias("hi"))
    rate = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve)["hi"]).first()[0]
    return cells.withColumn("chance", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))


def with_chances(docs: DataFrame, keep: float = 0.8, power: float = 0.7, targets: dict[str, DataFrame] | None = None, dims: Sequence[str] = ("source", "lang", "topic"), seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the dimensions, tokens, weight, chance, sampled.

    targets: of each dimension, a table of its categories and target shares; where absent, the shares found, tempered by
    `power`. A document's topic is its column topic, or a class of its length where there is none. A document is sampled if a
    number fixed by its id and the seed is below its cell's chance, so expected tokens are `keep` of all, in the target
    shares as far as no chance exceeds 1.

    Nulls: a null text has one token; null categories are one category, ''. Null ids share one number. Repeated rows are each
    sampled alike. Other columns are ignored. Empty table: no rows.
    """
    n = tokens(F.col(text_col))
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in dims if c in docs.columns}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("tokens"), *(v.alias(c) for c, v in given.items()))
    if "topic" in dims and "topic" not in given:
        rows = rows.withColumn("topic", topic_by_length(F.col("tokens")))
    rows = stored(rows)
    cells = stored(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    targets = {d: (targets or {}).get(d) if (targets or {}).get(d) is not None else tempered(cells, d, power) for d in dims}
    chances = stored(calibrated(rake(cells, targets), keep).drop("tokens"))
    if chances.count() <= BROADCAST_ROWS:
        chances = F.broadcast(chances)
    out = rows.join(chances, list(dims), "left")
    return out.select("doc_id", *dims, "tokens", "weight", "chance", (unit(F.col("doc_id"), seed) < F.col("chance")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **options) -> DataFrame:
    """The rows of docs that are sampled, with all their columns. No text moves where the cells are few enough to be broadcast.

    Rows with a null id are all sampled by one number, repeated rows alike. Empty table: no rows.
    """
    marked = with_chances(docs, id_col=id_col, text_col=text_col, seed=seed, **options)
    dims = options.get("dims", ("source", "lang", "topic"))
    cells = stored(marked.select(*dims, "chance").distinct())
    n = tokens(F.col(text_col))
    own = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else topic_by_length(n) for c in dims}
    chance, *names = unused(docs, "_chance", *(f"_own_{c}" for c in dims), *(f"_cell_{c}" for c in dims))
    mine, theirs = names[: len(dims)], names[len(dims) :]
    cells = cells.select(*(F.col(c).alias(name) for c, name in zip(dims, theirs, strict=True)), F.col("chance").alias(chance))
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    at = docs.withColumns({name: own[c] for c, name in zip(dims, mine, strict=True)})
    on = [F.col(a) == F.col(b) for a, b in zip(mine, theirs, strict=True)]
    return at.join(cells, on).where(unit(F.col(id_col).cast("long"), seed) < F.col(chance)).select(*(at[c] for c in docs.columns))
