"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_stored, stored


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and equal) neighbours of each node on its least neighbour."""
    near = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = near.join(least, "a")
    out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b of any ordered type, without nulls. One row per node that has a link: a, and b, the least node it reaches.

    Each round halves distances at least. A hot node's rows meet its least neighbour in a join that adaptive execution may split.
    """
    at, sign = stored(links.where("a != b").select("a", "b").distinct()), None
    for _ in range(rounds):
        new = stored(_star(_star(at, True), False))
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_stored(at)
        at = new
        if now == sign:
            return at
        sign = now
    raise RuntimeError("components did not settle")
