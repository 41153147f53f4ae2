"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, broadcast_if_small, stored, unused


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits (MD5) of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Only keys (an id, 16 and 32 bytes of hash) are shuffled for every row. Texts move only for hashes that occur more than
    once, and there the grouping by (hash, text) compares their bytes, with copies combined on the map side; so a group that
    holds a third of the rows costs one row per map task. Hashes found to hold different texts are split by SHA-256.
    Groups meet their rows again in a join that adaptive execution may split when a key is hot.

    Nulls: a null text is the empty text; a row with a null id loses to any id and stays only if its group has no other.
    Repeated rows: one row of those with the smallest id stays. Other columns are ignored. Empty table: no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("_t"))
    keyed = stored(base.select("doc_id", content_hash(F.col("_t")).alias("_h"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    several = stored(keyed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    few = broadcast_if_small(several, several.count())
    texts = base.withColumn("_h", content_hash(F.col("_t"))).join(few, "_h", "left_semi").groupBy("_h", "_t").agg(F.count("*").alias("_n"))
    collided = stored(texts.groupBy("_h").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_h", F.lit(True).alias("_split")))
    keyed = keyed.join(broadcast_if_small(collided, collided.count()), "_h", "left").withColumn("_sub", F.when(F.col("_split"), F.col("_sha"))).drop("_split")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_row").alias("row"))
    groups = keyed.groupBy("_h", "_sub").agg(F.min(order).alias("_first"), F.count("*").alias("_size"))
    rows = keyed.alias("r").join(groups.alias("g"), (F.col("r._h") == F.col("g._h")) & F.col("r._sub").eqNullSafe(F.col("g._sub")))
    return rows.select(
        F.col("r.doc_id").alias("doc_id"), F.col("g._first.doc_id").alias("keep_id"), F.col("g._size").alias("group_size"),
        (F.col("r._row") == F.col("g._first.row")).alias("kept"), F.lower(F.hex("r._sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows that go are few beside the rest, so they are what is joined: by broadcast within a checked size, else by shuffle.
    Rows that repeat both id and text (null ids too) are reduced to one; which one is not defined.
    """
    own, own_sha, lost, lost_sha = unused(docs, "_own", "_own_sha", "_lost", "_lost_sha")
    gone = stored(exact_groups(docs, id_col, text_col).where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(lost), F.unhex("text_sha256").alias(lost_sha)))
    marked = docs.withColumns({own: F.col(id_col).cast("long"), own_sha: F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))})
    out = marked.join(broadcast_if_small(gone, gone.count()), F.col(own).eqNullSafe(F.col(lost)) & (F.col(own_sha) == F.col(lost_sha)), "left_anti")
    twice = stored(docs.select(F.col(id_col).cast("long").alias(lost)).groupBy(lost).agg(F.count("*").alias("n")).where("n > 1").select(lost))
    if n := twice.count():
        again = F.col(own).eqNullSafe(F.col(lost))
        few = broadcast_if_small(twice, n)
        out = out.join(few, again, "left_anti").unionByName(out.join(few, again, "left_semi").dropDuplicates([own, own_sha]))
    return out.drop(own, own_sha)
