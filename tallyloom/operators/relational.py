"""Selections, pairings and hash-ranked sampling; all are plain relational plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import digest
from tallyloom.operators.storage import written


def complete_cases(df: DataFrame, item: str, arm: str, arms: Sequence[str]) -> DataFrame:
    """Rows of the items that have every one of the arms."""
    have = df.where(F.col(arm).isin(*arms)).groupBy(item).agg(F.count_distinct(arm).alias("n")).where(F.col("n") == len(arms))
    return df.join(have.select(item), item, "left_semi")


def paired(df: DataFrame, item: str, arm: str, base: str, other: str, columns: Sequence[str]) -> DataFrame:
    """One row per item that has both arms: the columns of each, as base_* and arm_*. One shuffle, no join. An item with two rows of
    one arm is refused."""
    picked = [F.max(F.when(F.col(arm) == value, F.struct(*columns))).alias(name) for name, value in (("b", base), ("o", other))]
    most = F.greatest(F.count_if(F.col(arm) == base), F.count_if(F.col(arm) == other)).alias("most")
    wide = df.where(F.col(arm).isin(base, other)).groupBy(item).agg(*picked, most)
    wide = wide.where(F.assert_true(F.col("most") <= 1, F.lit("an item has two rows of one arm")).isNull()).where("b is not null and o is not null")
    return wide.select(item, *(F.col(f"b.{c}").alias(f"base_{c}") for c in columns), *(F.col(f"o.{c}").alias(f"arm_{c}") for c in columns))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the place of each row in an order of the whole table, from 0; no task holds more than its range of it.

    Rows are sorted by ranges and written. A row's place in its range is known there; what lies before a range is the sum of the
    sizes of those before it, one number a range. The order must be of all rows, or ties fall as they come.
    """
    held = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    out = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def hash_rank(df: DataFrame, item: str, strata: Sequence[str], seed: int | str, name: str = "rank") -> DataFrame:
    """Rank of each row in its stratum by digest of seed and item; ties by item."""
    if not strata:
        return numbered(df, [digest(seed, F.col(item)), F.col(item)], name).withColumn(name, F.col(name) + 1)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*strata).orderBy(digest(seed, F.col(item)), item)))


def stratified_split(df: DataFrame, item: str, strata: Sequence[str], share: float, seed: int | str) -> DataFrame:
    """Adds calibration: the first ceil(share * n) rows of each stratum in hash order."""
    n = F.count("*").over(Window.partitionBy(*strata))
    return hash_rank(df, item, strata, seed).withColumn("calibration", F.col("rank") <= F.ceil(F.lit(share) * n)).drop("rank")


def first_of_each(df: DataFrame, item: str, strata: Sequence[str], n: int, seed: int | str) -> DataFrame:
    return hash_rank(df, item, strata, seed).where(F.col("rank") <= n).drop("rank")


def sharded(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds shard: rows in order, dealt in turn."""
    return numbered(df, [F.col(order)], "shard").withColumn("shard", F.col("shard") % shards)


def rotated(df: DataFrame, item: str, arms: Sequence[str], seed: int | str) -> DataFrame:
    """Adds position and first_arm: items in hash order take the arms' rotations in turn."""
    placed = numbered(df, [digest(seed, F.col(item)), F.col(item)], "position")
    return placed.withColumn("first_arm", F.element_at(F.array(*map(F.lit, arms)), (F.col("position") % len(arms)).cast("int") + 1))


def argmax_rows(df: DataFrame, keys: Sequence[str], score: str, ties: str) -> DataFrame:
    """The row of the highest score of each key, ties to the smallest label; aggregated on the map side."""
    best = F.min_by(F.struct(*df.columns), F.struct((-F.col(score)).alias("s"), F.col(ties).alias("t")))
    return df.groupBy(*keys).agg(best.alias("_b")).select("_b.*")


def top_share(df: DataFrame, score: str, order: str, share: float) -> DataFrame:
    """Rows of the highest scores: max(1, round(share * n)) of them (half to even), ties in order."""
    n = df.count()
    k = max(1, round(share * n))
    return df.orderBy(F.desc(score), order).limit(k)


def average_rank(df: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds rank: the mean of the ranks that equal scores take up."""
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ties = F.count("*").over(Window.partitionBy(*groups, score))
    return df.withColumn("rank", F.rank().over(by.orderBy(score)) + (ties - 1) / 2)


def deranged(df: DataFrame, order: str, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with the columns of the next one of its group, the last with the first's, as next_*; a null there gives way to the first's.

    Rows are sorted by ranges and written, so that no task holds a group, however large: a row's next one is in its range, but for the
    last row of a group there, whose next one is the first of the group in a later range. These are one row a range and group.
    """
    rows = written(df)  # a sort by ranges reads its rows up to three times
    held = written(rows.orderBy(*groups, order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    by, whole = Window.partitionBy(*groups).orderBy("_part"), Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = held.groupBy("_part", *groups).agg(F.min_by(F.struct(*columns), "_at").alias("_head"))
    heads = heads.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.lead("_head").over(by).alias("_later"), F.first("_head").over(whole).alias("_first"))
    out = held.withColumn("_next", F.lead(F.struct(*columns)).over(Window.partitionBy("_part", *groups).orderBy("_at")))
    met = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups))]
    out = out.join(F.broadcast(heads), met).withColumn("_next", F.coalesce("_next", "_later"))
    return out.select(*df.columns, *(F.coalesce(F.col("_next")[c], F.col("_first")[c]).alias(f"next_{c}") for c in columns))


def overlaps(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Pairs of spans (start, end) and others (o_start, o_end) of one key that overlap; an equi-join with a range on top."""
    return spans.join(others, key).where((F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start")))


def latest_before(points: Column, start: Column) -> Column:
    """The last of an array of points that is not after start, or null."""
    return F.array_max(F.filter(points, lambda p: p <= start))


def nearest_representative(rows: DataFrame, representatives: DataFrame, x: str, y: str, most: int = 10_000) -> DataFrame:
    """Each row with the nearest representative (ordinal, rx, ry), ties to the lower ordinal; repeated rows are returned each.

    The representatives, at most `most` of them, go to the rows as one array, so that no row is multiplied.
    """
    if (n := representatives.count()) > most:
        raise ValueError(f"{n} representatives are more than {most}")
    held = F.broadcast(representatives.agg(F.collect_list(F.struct("ordinal", "rx", "ry")).alias("_held")))  # one row
    square = lambda a, b: (a - b) * (a - b)
    near = F.array_min(F.transform("_held", lambda r: F.struct((square(F.col(x), r["rx"]) + square(F.col(y), r["ry"])).alias("d"), r["ordinal"].alias("ordinal"))))
    return rows.join(held).select(*rows.columns, near["ordinal"].alias("nearest"))


def pages_of(tiles: DataFrame, page: str, tile: str, text: str, expected: int) -> DataFrame:
    """Pages that have exactly the expected tiles, texts joined in order of tile."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(tile).alias("i"), F.col(text).alias("t"))))
    whole = tiles.groupBy(page).agg(parts.alias("p")).where((F.size("p") == expected) & (F.size(F.array_distinct(F.transform("p", lambda s: s["i"]))) == expected))
    return whole.select(page, F.array_join(F.transform("p", lambda s: s["t"]), "\n").alias("text"))
