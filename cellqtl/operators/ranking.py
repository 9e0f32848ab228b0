"""Ranks and false discovery rates of groups of any size: rows are dealt by ranges, and ranks are moved by what lies before a range."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: The grid of the share of true null hypotheses, and the degrees of freedom of its smoother.
LAMBDAS, SMOOTHER_DF = [i / 20 for i in range(1, 20)], 3


#: Rows up to which a table of ranges is sent to all tasks; a larger one is joined.
BROADCAST_ROWS = 100_000


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join in which null keys meet; with no keys, ``b`` has one row. ``b``'s keys are left out. ``small``: ``b`` is known to have few rows."""
    if not keys:
        return a.join(F.broadcast(b))  # one row
    other = b.toDF(*(f"_k{keys.index(c)}" if c in keys else c for c in b.columns))
    on = reduce(Column.__and__, (a[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)))
    return a.join(F.broadcast(other) if small else other, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with _rank (from 1, in each group), _m (rows of the group) and _part (number of the range). Rows of one group that
    are equal in ``order`` are spread by a hash, so that one value may hold any share of the rows. Rows are dealt once: sorted and numbered
    within their range and written; a rank is a number moved by what lies before the range."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *(o.alias(n) for o, n in zip(order, names, strict=True)), F.xxhash64(*df.columns).alias("_h"))
    keys = [*(F.col(b) for b in by), *names, "_h"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written, since another run of a task would cut the ranges elsewhere
    ranged = written(dealt.select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    parts = written(ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "parts")
    of = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each range
    moved = parts.withColumns({"_before": F.sum("_n").over(of.orderBy("_part")) - F.col("_n") - F.col("_first") + 1, "_m": F.sum("_n").over(of)})
    out = same(ranged, moved.drop("_n", "_first"), [*by, "_part"], small=parts.count() <= BROADCAST_ROWS)
    return out.withColumn("_rank", F.col("_before") + F.col("_at")).drop("_before", "_at")


def value_ranges(df: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, _value, _rows, _part) of distinct values that are not null, written; (by, _part, _base, _in, _all): of each range the rows before and
    in it, and those of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    ranged = written(counts.repartitionByRange(*by, "_value").withColumn("_part", F.spark_partition_id()), "values")
    of = Window.partitionBy(*(by or [F.lit(1)]))  # a row for each range
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_rows").alias("_in"))
    return ranged, parts.withColumns({"_base": F.sum("_in").over(of.orderBy("_part")) - F.col("_in"), "_all": F.sum("_in").over(of)})


def rows_before(by: list[str]) -> Column:
    """Of a value of :func:`value_ranges`, the rows of smaller ones in its range."""
    return F.sum("_rows").over(Window.partitionBy("_part", *by).orderBy("_value")) - F.col("_rows")


def _rates(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """by, _value, _bh: the Benjamini-Hochberg rate of each distinct p value, which is that of all its rows."""
    ranged, parts = value_ranges(df, p, by)
    at = same(ranged.withColumn("_at", rows_before(by)), parts, [*by, "_part"])
    v = written(at.withColumn("_v", F.col("_value") * F.col("_all") / (F.col("_base") + F.col("_at") + F.col("_rows"))).select(*by, "_part", "_value", "_v"), "rates")
    of = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    least = v.groupBy(*by, "_part").agg(F.min("_v").alias("_least"))
    above = least.withColumn("_above", F.min("_least").over(of.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    down = Window.partitionBy("_part", *by).orderBy(F.desc("_value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.least(F.lit(1.0), F.min("_v").over(down), F.col("_above"))
    return same(v, above, [*by, "_part"]).select(*by, "_value", rate.alias("_bh"))


def fdr_rates(df: DataFrame, p: str, by: list[str], bh: str | None = None, q: str | None = None) -> DataFrame:
    """``df`` with the Benjamini-Hochberg rate and the q value of each row, under the names given, from one ranking of the distinct p values.
    Rows meet their value's rates in one join; null p values have null rates and count for nothing. Rows are written first, as they are read up to three times."""
    df = written(df, "rows")
    rates = _rates(df, p, by)
    if q:
        rates = same(rates, null_share(df, p, by).drop("m"), by, "left").withColumn(q, F.col("pi0") * F.col("_bh")).drop("pi0")
    rates = rates.withColumnRenamed("_bh", bh) if bh else rates.drop("_bh")
    # rows without a p value have no rate to meet, and would all be of one key
    there, names = F.col(p).isNotNull(), [n for n in (bh, q) if n]
    met = same(df.where(there), rates.withColumnRenamed("_value", p), [*by, p], "left").select(*df.columns, *names)
    return met.union(df.where(~there).select("*", *(F.lit(None).cast("double").alias(n) for n in names)))


def bh_fdr(df: DataFrame, p: str, by: list[str], name: str = "fdr") -> DataFrame:
    """W9. Benjamini-Hochberg in each run: the running least of p * m / rank from the largest p, at most 1. A null p has a null
    rate and counts for nothing."""
    return fdr_rates(df, p, by, bh=name)


def smoother_weights(x: list[float] = LAMBDAS, df: float = SMOOTHER_DF) -> np.ndarray:
    """Weights of the points' values in the last fitted value of a natural cubic smoothing spline with ``df`` degrees of freedom."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    values = np.maximum(values, 0)
    low, high = -30.0, 30.0  # logarithm of the penalty
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(mid) * values)).sum() > df else (low, mid)
    return vectors[-1] / (1 + np.exp(low) * values) @ vectors.T


def null_share(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """by, m, pi0: Storey's share of true null hypotheses of each run, from 19 counts in one aggregate; null where it is not above 0."""
    at = [F.count_if(F.col(p) >= x).alias(f"_c{i}") for i, x in enumerate(LAMBDAS)]
    g = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("m"), *at)
    each = [F.lit(float(w)) * F.col(f"_c{i}") / F.col("m") / F.lit(1 - x) for i, (w, x) in enumerate(zip(smoother_weights(), LAMBDAS, strict=True))]
    pi0 = F.least(F.lit(1.0), reduce(Column.__add__, each))
    return g.select(*by, "m", F.when(pi0 > 0, pi0).alias("pi0"))


def qvalues(df: DataFrame, p: str, by: list[str], name: str = "q") -> DataFrame:
    """H1. pi0 times the Benjamini-Hochberg rate."""
    return fdr_rates(df, p, by, q=name)


def pi1(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """H2. by, m, pi1: 1 - pi0 of each run after p is divided by its largest value."""
    largest = df.groupBy(*by).agg(F.max(p).alias("_largest"))
    scaled = same(df.select(*by, F.col(p).alias("_p")), largest, by).withColumn("_p", F.try_divide("_p", "_largest"))
    return null_share(scaled, "_p", by).select(*by, "m", (1 - F.col("pi0")).alias("pi1"))
