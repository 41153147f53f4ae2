"""Checks that fail a plan closed: keys, grains and equal key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if no key repeats. One aggregation that stops at the first key found twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise GuardError(f"rows repeat {list(keys)}")
    return df


def assert_grain(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """df, if each key has exactly so many rows."""
    if df.groupBy(*keys).count().where(F.col("count") != rows).limit(1).count():
        raise GuardError(f"not {rows} rows for each {list(keys)}")
    return df


def assert_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    a, b = left.select(*keys), right.select(*keys)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise GuardError(f"the sides differ in {list(keys)}")


def assert_disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    if left.select(*keys).join(right.select(*keys), list(keys), "left_semi").limit(1).count():
        raise GuardError(f"the sides share {list(keys)}")


def assert_one_cell(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """df, if all its rows lie in one cell; results are never pooled across cells."""
    if df.select(*cell).distinct().limit(2).count() > 1:
        raise GuardError(f"rows of several {list(cell)}")
    return df


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
