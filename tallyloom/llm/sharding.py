"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, group by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

#: A group with over this share of one shard's capacity in any measure is placed by itself; smaller groups go in bundles.
ALONE = 1 / 256
#: Bundles of small groups per shard.
BUNDLES = 256
#: Parts that all rows would be dealt to; a group placed by itself has as many of them as its share, so no task numbers a whole hot group.
PARTS = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_tokens(text: Column) -> Column:
    """White-space words, counted without splitting: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), largest first, where item . residual capacity is highest."""
    total = items.sum(axis=0).astype(float)
    share = items / np.where(total > 0, total, 1) * shards
    residual, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        out[k] = s = int(np.argmax(residual @ share[k]))
        residual[s] -= share[k]
    return out


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Groups are the rows with equal texts (by MD5; null equals empty). A group stays in one shard unless it exceeds a shard's
    capacity in some measure; then its parts, dealt by a hash of id and row, are placed one by one. Groups over ALONE of a
    capacity are at most shards / ALONE per measure, and all others are summed into shards * BUNDLES bundles: both bounds are
    free of the input's size, so the driver places them with the greedy rule. Slots number rows by unit, so each task sorts
    the rows of some units and adds the unit's offset.

    Nulls: a null text has size 1 and crc 0; rows with a null id are placed as any other. Repeated rows are each placed once.
    Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_size(text).alias("size"), text_tokens(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_h"), F.monotonically_increasing_id().alias("_row"),
    ))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    limit = [max(1.0, (x or 0) / shards) for x in total]
    groups = stored(rows.groupBy("_h").agg(*sums))
    large = F.greatest(*(F.col(c) / F.lit(m) for c, m in zip(("size", "tokens", "rows"), limit, strict=True)))
    alone = groups.where(large > ALONE).select("_h", (large > 1).alias("_cut"), F.ceil(F.col("rows") * PARTS / F.lit(max(1, total["rows"] or 0))).alias("_parts"))
    # parts of a group placed alone; bundle of every other
    rows = rows.join(F.broadcast(alone), "_h", "left")
    part = F.pmod(F.xxhash64("doc_id", "_row"), F.col("_parts")).cast("int")
    bundle = F.pmod(F.xxhash64("_h"), F.lit(shards * BUNDLES)).cast("int")
    rows = rows.withColumn("_part", F.when(F.col("_cut").isNull(), bundle).otherwise(part)).withColumn("_own", F.when(F.col("_cut").isNotNull(), F.col("_h")))
    units = rows.groupBy("_own", "_part", "_cut").agg(*sums).toPandas().sort_values(["_own", "_part"], kind="stable", na_position="last", key=lambda c: c.map(lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x)).reset_index(drop=True)
    # a group that fits a shard is one item; parts of a larger one and bundles are items of their own
    keys = [("g", bytes(o)) if o is not None and not cut else ("p", None if o is None else bytes(o), p) for o, p, cut in zip(units["_own"], units["_part"], units["_cut"], strict=True)]
    code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    item = np.array([code[k] for k in keys], np.int64)
    weights = np.zeros((len(code), 3))
    np.add.at(weights, item, units[["size", "tokens", "rows"]].to_numpy(float))
    units["shard"] = place(weights, shards)[item] if len(code) else np.zeros(0, np.int64)
    units["_offset"] = units.groupby("shard")["rows"].cumsum() - units["rows"]
    table = spark.createDataFrame([(None if o is None else bytes(o), int(p), int(s), int(f)) for o, p, s, f in zip(units["_own"], units["_part"], units["shard"], units["_offset"], strict=True)], "_own2 binary, _part2 int, shard int, _offset long")
    rows = rows.join(F.broadcast(table), F.col("_own").eqNullSafe(F.col("_own2")) & (F.col("_part") == F.col("_part2")))
    within = F.row_number().over(Window.partitionBy("_own", "_part").orderBy("doc_id", "_row"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_offset") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
