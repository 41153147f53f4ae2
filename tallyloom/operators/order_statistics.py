"""Exact order statistics of groups of any size: buckets are counted until few rows are left around each rank; no group is gathered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.storage import written

#: Buckets of a pass, and rows of a bucket that may be sorted in one buffer.
BUCKETS, FEW = 1024, 4096


def nth_values(df: DataFrame, groups: Sequence[str], value: str, positions: Mapping[str, Column], buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """One row for each group with values: the groups, n (values that are not null) and, for each name, the value at that position
    (from 0, an expression of n; held within 0 and n - 1) of the sorted values.

    Each pass splits the range in which a rank lies into equal buckets and counts them, map tasks first; the rank's bucket is the
    next range. It ends when a bucket holds few rows or one value only. NaN takes no part. Groups and values are written once, so that
    passes, and the filter, do not make again what they come from.
    """
    rows = written(df.select(*groups, F.col(value).cast("double").alias("_v"))).where("_v is not null and not isnan(_v)")
    base = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    held = lambda p: F.least(F.greatest(p.cast("long"), F.lit(0)), F.col("n") - 1)
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), held(p).alias("rank")) for k, p in positions.items())))
    state = base.withColumn("_w", wanted).select(*groups, F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"), "_lo", "_hi", F.col("n").alias("_held"))
    on = [*groups]
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))

    def meet(state: DataFrame) -> DataFrame:
        return (rows.join(state, on) if on else rows.crossJoin(F.broadcast(state))).where(inside)

    while state.where((F.col("_held") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        step = F.col("_hi") / buckets - F.col("_lo") / buckets
        spread = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / step))
        bucket = F.when(step > 0, spread).when(F.col("_v") > F.col("_lo"), 1).otherwise(0)  # no step: neighbours at the edge of a double's range
        counted = meet(state).groupBy(*on, "_name", "_rank", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_c").over(Window.partitionBy(*on, "_name").orderBy("_b")) - F.col("_c")
        at = counted.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        state = at.select(*on, "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", F.col("_c").alias("_held"))
        state = written(state)
    one = state.where("_lo = _hi").select(*on, "_name", F.col("_lo").alias("_x"))
    near = meet(state.where("_lo < _hi")).groupBy(*on, "_name", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    found = one.unionByName(near.select(*on, "_name", F.get("_s", F.col("_rank").cast("int")).alias("_x")))
    wide = found.groupBy(*on).agg(*(F.max(F.when(F.col("_name") == k, F.col("_x"))).alias(k) for k in positions))
    sizes = base.select(*groups, "n")
    return sizes.join(wide, on) if on else sizes.crossJoin(F.broadcast(wide))
