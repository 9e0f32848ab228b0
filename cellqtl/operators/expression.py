"""Expression matrices in long form: gene, sample, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import correlation_p
from ..functions.scalars import correlation, normal_quantile
from .blocks import column_products
from .order import average_ranks

#: Share by which a distance in standard deviations may miss its value for the rounding of sums.
ROUNDING = 1e-12


def inverse_normal_rank(expr: DataFrame) -> DataFrame:
    """W10. Each gene's values by the normal quantile of their average rank among its samples."""
    r = average_ranks(expr, "value", ["gene"])
    return r.withColumn("u", F.col("rank") / (F.count("*").over(Window.partitionBy("gene")) + 1)).withColumn("z", normal_quantile(F.col("u"))).drop("rank")


def top_expressed_genes(expr: DataFrame, n: int) -> DataFrame:
    """W12. The n genes of highest mean."""
    return expr.groupBy("gene").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "gene").limit(n)


def filter_genes(expr: DataFrame, min_obs: int, min_cpm: float) -> DataFrame:
    """H11. Genes that vary, with more than min_obs samples above 0 and a mean count per million above min_cpm."""
    size = expr.groupBy("sample").agg(F.sum("value").alias("_size"))
    g = expr.join(size, "sample").groupBy("gene").agg(F.var_samp("value").alias("_v"), F.count_if(F.col("value") > 0).alias("n_obs"), F.avg(F.col("value") / F.col("_size") * 1e6).alias("mean_cpm"))
    return g.where((F.col("_v") != 0) & (F.col("n_obs") > min_obs) & (F.col("mean_cpm") > min_cpm)).drop("_v")


def filter_steps(expr: DataFrame, min_obs: int, min_cpm: float) -> DataFrame:
    """H11. (filter, n_genes) after each step: Input, Varfilter, MinObsFilter, CPMFilter."""
    size = expr.groupBy("sample").agg(F.sum("value").alias("_size"))
    g = expr.join(size, "sample").groupBy("gene").agg((F.var_samp("value") != 0).alias("_v"), (F.count_if(F.col("value") > 0) > min_obs).alias("_o"), (F.avg(F.col("value") / F.col("_size") * 1e6) > min_cpm).alias("_c"))
    v, o, c = (F.coalesce(F.col(x), F.lit(False)) for x in ("_v", "_o", "_c"))
    steps = {"Input": F.lit(True), "Varfilter": v, "MinObsFilter": v & o, "CPMFilter": v & o & c}
    return g.agg(F.array(*(F.struct(F.lit(k).alias("filter"), F.count_if(x).alias("n_genes")) for k, x in steps.items())).alias("_s")).select(F.inline("_s"))


def proportional_fit(counts: DataFrame, log1p: bool = False, target: float | None = None) -> DataFrame:
    """H13. Each cell scaled to the depth ``target``, else to the mean depth of all cells, optionally followed by log(1 + x). A cell without depth
    has null."""
    depth = counts.groupBy("barcode").agg(F.sum("cnt").alias("_d"))
    rows = counts.join(depth, "barcode")
    if target is None:
        rows = rows.join(F.broadcast(depth.agg(F.avg("_d").alias("_m"))))  # one row
    fit = F.try_divide(F.col("cnt") * (F.col("_m") if target is None else F.lit(float(target))), "_d")
    return rows.withColumn("fit", F.log1p(fit) if log1p else fit).drop("_d", "_m")


def fit_chain(counts: DataFrame) -> DataFrame:
    """H13. Raw counts scaled to the mean depth with log(1 + x), and these scaled again to their own mean depth."""
    once = proportional_fit(counts, True).select("barcode", "gene", F.col("fit").alias("cnt"))
    return proportional_fit(once).select("barcode", "gene", "fit")


def matched_correlation(a: DataFrame, b: DataFrame, by: str, method: str = "pearson") -> DataFrame:
    """H16 and H4. Correlation of two matrices over their common cells, for each gene or each sample; Spearman's is
    Pearson's of average ranks. Null where a side hardly varies."""
    j = a.select("gene", "sample", F.col("value").cast("double").alias("x")).join(b.select("gene", "sample", F.col("value").cast("double").alias("y")), ["gene", "sample"])
    if method == "spearman":
        for c in ("x", "y"):
            j = average_ranks(j, c, [by]).withColumn(c, F.col("rank")).drop("rank")
    varies = (F.stddev_samp("x") > 1e-7) & (F.stddev_samp("y") > 1e-7)
    return j.groupBy(by).agg(F.count("*").alias("n"), F.when(varies, correlation("x", "y")).alias("r"))


def matched_correlation_by_dataset(a: DataFrame, b: DataFrame, links: DataFrame, center: bool = False) -> DataFrame:
    """H16. For each gene across samples, in each dataset (expression_id, dataset of ``links``) and over all (null; left out with one dataset): number and
    Pearson's r; ``center`` takes each gene's mean out first."""
    x = lambda m, v: m.select("gene", "sample", F.col("value").cast("double").alias(v))
    j = x(a, "x").join(x(b, "y"), ["gene", "sample"]).join(links.select(F.col("expression_id").alias("sample"), "dataset"), "sample")
    if center:
        w = Window.partitionBy("gene")
        j = j.withColumns({c: F.col(c) - F.avg(c).over(w) for c in ("x", "y")})
    varies = (F.stddev_samp("x") > 1e-7) & (F.stddev_samp("y") > 1e-7)
    g = j.groupingSets([[F.col("gene")], [F.col("gene"), F.col("dataset")]], "gene", "dataset").agg(F.grouping("dataset").alias("_all"), F.count(F.lit(1)).alias("n"), F.when(varies, correlation("x", "y")).alias("r"))
    many = j.select("dataset").distinct().agg((F.count(F.lit(1)) > 1).alias("_many"))
    return g.join(F.broadcast(many)).where("_all = 0 OR _many").drop("_all", "_many")


def all_sample_correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """H16. sample_a, sample_b, n, r: every sample of one matrix against every one of the other over the genes that both have, for pairs with one at
    least. Six sums of each pair come from blocks of genes by blocks of samples (:mod:`.blocks`); null where a side hardly varies."""
    cells = lambda m: m.where("value is not null").select(F.col("gene").alias("row"), F.col("sample").alias("col"), F.col("value").cast("double").alias("x"))
    # about each sample's mean, so that little is lost in the sums of squares
    centre = lambda m: (x := cells(m)).join(x.groupBy("col").agg(F.avg("x").alias("_m")), "col").select("row", "col", (F.col("x") - F.col("_m")).alias("x"))
    labels = lambda m: m.select(F.col("sample").alias("label")).distinct()
    pairs = column_products(centre(a), labels(a), [], centre(b), labels(b), whole=True)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    varies = (F.sqrt(F.try_divide(vx, n - 1)) > 1e-7) & (F.sqrt(F.try_divide(vy, n - 1)) > 1e-7)
    r = F.when(varies, (F.col("xy") - sx * sy / n) / F.sqrt(vx * vy))
    return pairs.select(F.col("col_a").alias("sample_a"), F.col("col_b").alias("sample_b"), n.cast("long").alias("n"), r.alias("r"))


def column_correlations(a: DataFrame, b: DataFrame, key: str, columns_a: list[str], columns_b: list[str]) -> DataFrame:
    """H17. Every listed column of one table against every one of the other over rows with both values, in one pass."""
    x = a.select(key, *(F.col(c).cast("double").alias(f"a_{c}") for c in columns_a))
    y = b.select(key, *(F.col(c).cast("double").alias(f"b_{c}") for c in columns_b))
    pairs = F.array(*(F.struct(F.lit(p).alias("column_a"), F.lit(q).alias("column_b"), F.col(f"a_{p}").alias("x"), F.col(f"b_{q}").alias("y")) for p in columns_a for q in columns_b))
    return x.join(y, key).select(F.inline(pairs)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("column_a", "column_b").agg(F.count("*").alias("n"), correlation("x", "y").alias("r"))


def correlations_by_dataset(a: DataFrame, b: DataFrame, key: list[str], columns_a: list[str], columns_b: list[str], by: list[str], method: str = "pearson") -> DataFrame:
    """H17. by (columns of ``a``), column_a, column_b, n, r, p: every listed column of one table against every one of the other in each dataset, over the rows that have
    both values (each pair leaves out its own rows). ``spearman`` ranks the rows that are left to a pair. Null where a column hardly varies."""
    x = a.select(*key, *by, *(F.col(c).cast("double").alias(f"a_{c}") for c in columns_a))
    y = b.select(*key, *(F.col(c).cast("double").alias(f"b_{c}") for c in columns_b))
    pairs = F.array(*(F.struct(F.lit(p).alias("column_a"), F.lit(q).alias("column_b"), F.col(f"a_{p}").alias("x"), F.col(f"b_{q}").alias("y")) for p in columns_a for q in columns_b))
    of = [*by, "column_a", "column_b"]
    rows = x.join(y, key).select(*by, F.inline(pairs)).where("x IS NOT NULL AND y IS NOT NULL")
    if method == "spearman":
        for c in ("x", "y"):
            rows = average_ranks(rows, c, of).withColumn(c, F.col("rank")).drop("rank")
    elif method != "pearson":
        raise ValueError(method)
    varies = (F.stddev_samp("x") > 1e-7) & (F.stddev_samp("y") > 1e-7)
    g = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.when(varies, correlation("x", "y")).alias("r"))
    return g.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def masked_correlations(a: DataFrame, b: DataFrame, key: str, columns_a: list[str], columns_b: list[str], drop_paired_zero: bool = False, triangle: bool = False, alpha: float = 0.05) -> DataFrame:
    """H17 with p values: r is 0 where p is not below alpha, null where a column hardly varies. ``drop_paired_zero`` leaves rows out in which both are 0;
    ``triangle`` keeps each pair of a table with itself once."""
    x = a.select(key, *(F.col(c).cast("double").alias(f"a_{c}") for c in columns_a))
    y = b.select(key, *(F.col(c).cast("double").alias(f"b_{c}") for c in columns_b))
    wanted = [(p, q) for i, p in enumerate(columns_a) for k, q in enumerate(columns_b) if not triangle or k < i]
    pairs = F.array(*(F.struct(F.lit(p).alias("column_a"), F.lit(q).alias("column_b"), F.col(f"a_{p}").alias("x"), F.col(f"b_{q}").alias("y")) for p, q in wanted))
    rows = x.join(y, key).select(F.inline(pairs)).where("x IS NOT NULL AND y IS NOT NULL")
    if drop_paired_zero:
        rows = rows.where("NOT (x = 0 AND y = 0)")
    varies = (F.stddev_samp("x") > 1e-7) & (F.stddev_samp("y") > 1e-7)
    g = rows.groupBy("column_a", "column_b").agg(F.count(F.lit(1)).alias("n"), F.when(varies, correlation("x", "y")).alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))
    return g.withColumn("masked_r", F.when(F.col("r").isNotNull(), F.when(F.col("p") < alpha, F.col("r")).otherwise(0.0)))


def outliers(scores: DataFrame, z: float = 3.0) -> DataFrame:
    """H7. Samples of which some component lies z or more standard deviations from its mean; one that does not vary has none. A distance of z itself
    counts whichever way its last bit falls, which depends on the order in which rows are added up (``ROUNDING``)."""
    m = scores.groupBy("component").agg(F.avg("value").alias("_m"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    far = F.abs((F.col("value") - F.col("_m")) / F.col("_s"))
    return scores.join(m, "component").groupBy("sample").agg(F.max(far).alias("max_z")).withColumn("outlier", F.col("max_z") >= z * (1 - ROUNDING))
