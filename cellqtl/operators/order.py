"""Exact order statistics and average ranks of groups of any size.

Equal values of a group are counted first, so a value may hold any share of the rows. The counts are dealt by ranges of group and value
and written; a range needs of the others only how many rows lie before it. No group, and no value, is gathered in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import rows_before, same, value_ranges


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with rank: from 1 in each group, ties share their mean; null for null values. Rows meet their value's rank in a join on group and value;
    they are written first, as they are read for both."""
    df = written(df, "rows")
    ranged, parts = value_ranges(df, value, by)
    at = same(ranged.withColumn("_at", rows_before(by)), parts, [*by, "_part"])
    ranks = at.select(*by, F.col("_value").alias(value), (F.col("_base") + F.col("_at") + (F.col("_rows") + 1) / 2.0).alias("rank"))
    return same(df, ranks, [*by, value], "left")


def values_at(df: DataFrame, value: str, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, and for each name of ``places`` the value at a place (from 0), which a function gives from the number of a group's values, and as <name>_rank that
    value's average rank. As ranks grow with values, a cut by rank is a cut at such a value, so rows need not meet their ranks."""
    ranged, parts = value_ranges(df, value, by)
    place = {n: f(F.col("_all")) for n, f in places.items()}
    held = lambda k, first, n: (first <= k) & (k < first + n)
    needed = reduce(Column.__or__, (held(k, F.col("_base"), F.col("_in")) for k in place.values()))
    rows = same(ranged, parts.where(needed), [*by, "_part"]).withColumn("_first", F.col("_base") + rows_before(by))
    found = F.struct("_value", (F.col("_first") + (F.col("_rows") + 1) / 2.0).alias("rank"))
    g = rows.groupBy(*by).agg(*(F.max(F.when(held(k, F.col("_first"), F.col("_rows")), found)).alias(n) for n, k in place.items()))
    return g.select(*by, *(c for n in place for c in (F.col(f"{n}._value").alias(n), F.col(f"{n}.rank").alias(f"{n}_rank"))))


def quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float | Callable[[Column], Column]]) -> DataFrame:
    """by, and for each name of ``wanted`` the quantile at its fraction, between two values in proportion. Instead of a fraction, a function may
    give the place (from 0) from the number of a group's values; a place outside of them has null. Only ranges that hold a wanted rank are
    sorted, all of them in one pass; a group of which none is there is left out."""
    ranged, parts = value_ranges(df, value, by)
    place = {n: f(F.col("_all")) if callable(f) else (F.col("_all") - 1) * F.lit(float(f)) for n, f in wanted.items()}
    held = lambda k, first, n: (first <= k) & (k < first + n)
    ends = {n: (F.floor(h), F.ceil(h)) for n, h in place.items()}
    needed = reduce(Column.__or__, (held(k, F.col("_base"), F.col("_in")) for e in ends.values() for k in e))
    rows = same(ranged, parts.where(needed), [*by, "_part"]).withColumn("_first", F.col("_base") + rows_before(by))
    at = [F.max(F.when(held(k, F.col("_first"), F.col("_rows")), F.col("_value").cast("double"))).alias(f"_{i}{j}") for i, e in enumerate(ends.values()) for j, k in enumerate(e)]
    g = rows.groupBy(*by).agg(F.max("_all").alias("_all"), *at)
    return g.select(*by, *((F.col(f"_{i}0") + (F.col(f"_{i}1") - F.col(f"_{i}0")) * (h - F.floor(h))).alias(n) for i, (n, h) in enumerate(place.items())))
