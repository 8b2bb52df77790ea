"""Joins and set operators on typed frames; empty text joins empty text, null is filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the order of a column, by a partial aggregate (no sort of the whole key)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    least = F.min(F.struct(F.col(order).alias("__o"), *(F.col(c) for c in rest if c != order)))
    found = df.groupBy(*keys).agg(least.alias("__f"))
    return found.select(*(F.col("__f.__o").alias(c) if c == order else F.col(c) if c in keys else F.col(f"__f.`{c}`") for c in df.columns))


def last_value(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(out))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left, duplicates included, whose keys right has."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi").select(*left.columns)
