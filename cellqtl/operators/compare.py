"""Comparison of the outputs of two tools or runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles
from .ranking import same


def count_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """J7. Left join on barcode and gene; what is missing counts as 0."""
    y = b.select("barcode", "gene", F.col("cnt").alias("cnt_b"))
    return a.join(y, ["barcode", "gene"], "left").withColumn("cnt_b", F.coalesce("cnt_b", F.lit(0))).withColumn("delta", F.col("cnt") - F.col("cnt_b"))


def delta_summary(delta: DataFrame, by: str) -> DataFrame:
    """A9. Sums by gene or barcode, and the delta as a share of the larger total."""
    s = delta.groupBy(by).agg(F.sum("cnt").alias("a"), F.sum("cnt_b").alias("b"), F.sum("delta").alias("delta"))
    return s.withColumn("delta_pct", F.try_divide(F.col("delta").cast("double"), F.greatest("a", "b").cast("double")))


def delta_by_cell_type(delta: DataFrame, cells: DataFrame) -> DataFrame:
    """A9. By cell type: cells, counts, their loss, its share of the counts in percent, and the least, greatest and mean loss of a cell."""
    per = delta_summary(delta, "barcode").select("barcode", "a", F.col("delta").alias("_d")).join(cells.select("barcode", "cell_type"), "barcode")
    g = per.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("a").alias("counts"), F.sum("_d").alias("delta"), F.min("_d").alias("low"), F.max("_d").alias("high"), F.avg("_d").alias("mean"))
    return g.withColumn("prop", F.try_divide(100.0 * F.abs("delta"), F.col("counts")))


def delta_by_include(delta: DataFrame, include: DataFrame, tasks: int | None = None) -> DataFrame:
    """A9. By barcode: the loss of genes that are included, of the others, and in total. ``include`` is a list of genes; ``tasks``: deltas are dealt to as many where they
    meet it, as a long list makes Spark sort them."""
    include = include.select("gene")
    if tasks:
        delta, include = delta.repartition(tasks, "gene"), include.repartition(tasks, "gene")
    j = delta.join(include.distinct().withColumn("_in", F.lit(True)), "gene", "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("delta"))), F.lit(0))
    return j.groupBy("barcode").agg(part(F.col("_in").isNotNull()).alias("included"), part(F.col("_in").isNull()).alias("excluded"), F.sum("delta").alias("total"))


def confusion_matrix(df: DataFrame, x: str, y: str, labels: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A10. Counts of label pairs and their share of the row, by panel if any; null is the label nan. ``labels`` translates first."""
    table = F.create_map(*(F.lit(v) for kv in (labels or {}).items() for v in kv)) if labels else None

    def label(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        return v if table is None else F.coalesce(F.element_at(table, v), v)

    n = df.groupBy(*by, label(y).alias("row"), label(x).alias("col")).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "row")))


def true_positive_rate(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A10. Of the rows whose label both sides know: how many agree, all of them, and the rate. ``matrix`` is a confusion matrix."""
    known = matrix.select(*by, F.col("col").alias("row")).distinct()
    g = matrix.join(known, [*by, "row"], "left_semi").groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("row") == F.col("col"), F.col("n"))), F.lit(0)).alias("agree"), F.sum("n").alias("total"))
    return g.withColumn("tpr", F.try_divide(F.col("agree").cast("double"), F.col("total")))


def exclusive_overlap(df: DataFrame, item: str, source: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A15. Number of items found in exactly each combination of sources, by folder if any."""
    held = df.groupBy(*by, item).agg(F.array_join(F.array_sort(F.collect_set(source)), "+").alias("combination"))
    return held.groupBy(*by, "combination").agg(F.count("*").alias("n"))


def all_combinations(overlap: DataFrame, sources: list[str]) -> DataFrame:
    """A15. ``overlap`` (combination, n) summed over folders, with a row for each combination of the sources, also those that no item has."""
    names = ["+".join(x for i, x in enumerate(sorted(sources)) if k >> i & 1) for k in range(1, 1 << len(sources))]
    every = overlap.sparkSession.createDataFrame([(n,) for n in names], "combination string")
    return every.join(overlap.groupBy("combination").agg(F.sum("n").alias("n")), "combination", "left").fillna(0, ["n"])


def combine_tool_calls(calls: DataFrame, key: list[str], tool: str, call: str, tools: list[str], inner: bool = False) -> DataFrame:
    """J8. One row per key with each tool's call, missing ones unknown: one shuffle for any number of tools. ``inner``: only keys that
    every tool has."""
    each = [F.max(F.when(F.col(tool) == t, F.col(call))).alias(f"call_{t}") for t in tools]
    out = calls.groupBy(*key).agg(*each)
    names = [f"call_{t}" for t in tools]
    return out.dropna(subset=names) if inner else out.fillna("unknown", names)


def quantile_bins(df: DataFrame, value: str, by: list[str], n: int) -> DataFrame:
    """W11. Exact edges of n equally frequent bins."""
    return quantiles(df, value, by, {f"edge_{i}": i / n for i in range(n + 1)})


def into_bins(df: DataFrame, value: str, by: list[str], n: int) -> DataFrame:
    """W11. Rows with the number of their bin (from 1; a value on an edge is in the lower bin, the least value in the first) and its edges as a
    label."""
    edges = quantile_bins(df, value, by, n).select(*by, F.array(*(F.col(f"edge_{i}") for i in range(n + 1))).alias("_e"))
    at = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(value))))
    label = lambda i: F.round(F.element_at("_e", i), 6).cast("string")
    out = same(df, edges, by).withColumn("bin", F.when(F.col(value).isNotNull(), at))
    return out.withColumn("label", F.concat(F.lit("("), label(F.col("bin")), F.lit(", "), label(F.col("bin") + 1), F.lit("]"))).drop("_e")


def qc_metric_limits(df: DataFrame, value: str, tag: str) -> DataFrame:
    """A26. Least, greatest and median value overall and of rows that pass."""
    ok = F.when(F.col(tag) == "NotOutlier", F.col(value))
    limits = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.min(ok), 2).alias("low_ok"), F.round(F.max(ok), 2).alias("high_ok"))
    return limits.join(F.broadcast(quantiles(df, value, [], {"median": 0.5})), how="left").select("low", "high", "median", "low_ok", "high_ok")  # one row


def qc_metrics_limits(df: DataFrame, metrics: list[str], tag: str) -> DataFrame:
    """A26 for several metrics, one row each, in one pass. The limits of rows that pass are null where no row is an outlier."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    rows = df.select(F.col(tag).alias("_t"), F.inline(each))
    ok, out = F.when(F.col("_t") == "NotOutlier", F.col("value")), F.count_if(F.col("_t") != "NotOutlier") > 0
    limits = rows.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.when(out, F.round(F.min(ok), 2)).alias("low_ok"), F.when(out, F.round(F.max(ok), 2)).alias("high_ok"))
    return limits.join(quantiles(rows, "value", ["metric"], {"median": 0.5}), "metric", "left").select("metric", "low", "high", "median", "low_ok", "high_ok")
