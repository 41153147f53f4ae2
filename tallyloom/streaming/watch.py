"""Streams: windowed totals with late data, resumable appends, and a loop watch that keeps state per output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.kernels import cut_at_loop


def windowed_totals(events: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and sum of each window and key; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """For foreachBatch: rows whose keys are not yet there; running a batch again changes nothing."""
    spark = batch.sparkSession
    try:
        batch = batch.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.dropDuplicates(keys).write.mode("append").parquet(path)


def watch_loops(pieces: DataFrame, k: int = 8, k_long: int = 6, keep: int = 6000) -> DataFrame:
    """pieces: id, piece. For each output as it grows: id, length, stopped (a loop has begun); the last `keep` characters are held."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, length, stopped = state.get if state.exists else ("", 0, False)
        for f in frames:
            for piece in f["piece"]:
                if not stopped:
                    text, length = (text + piece)[-keep:], length + len(piece)
                    stopped = len(cut_at_loop(text, k, k_long)) < len(text)
        state.update((text, length, stopped))
        yield pd.DataFrame({"id": [key[0]], "length": [length], "stopped": [stopped]})

    return pieces.groupBy("id").applyInPandasWithState(step, "id string, length long, stopped boolean", "text string, length long, stopped boolean", "update", GroupStateTimeout.NoTimeout)
