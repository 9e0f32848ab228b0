"""Barcode quality control, cell metadata and pseudobulk. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles
from .ranking import ranked, same


def barcode_qc(counts: DataFrame, genes: DataFrame, marker: str | None = None) -> DataFrame:
    """A1. counts (barcode, gene, cnt; a pool column if there is one is part of the key), genes (gene, is_rb, is_mt): one aggregate, partial
    sums first. Genes that the list lacks count like any other. ``marker``: the symbol whose counts are told beside."""
    by = [c for c in ("pool", "barcode") if c in counts.columns]
    flags = [c for c in ("gene", "is_rb", "is_mt", "symbol") if c in genes.columns and (c != "symbol" or marker)]
    c = counts.join(genes.select(*flags), "gene", "left")
    part = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("cnt"))), F.lit(0))
    more = [part(F.col("symbol") == marker).alias("marker")] if marker else []
    out = c.groupBy(*by).agg(
        F.sum("cnt").alias("n_count"), F.count_if(F.col("cnt") > 0).alias("n_feature"), part(F.col("is_rb")).alias("rb"), part(F.col("is_mt")).alias("mt"), *more
    )
    share = lambda c: F.try_divide(100.0 * F.col(c), F.col("n_count"))
    return out.withColumns({"complexity": share("n_feature"), "percent_rb": share("rb"), "percent_mt": share("mt")})


def umi_rank(qc: DataFrame, pool: str) -> DataFrame:
    """W1, W2. Rank by counts in the pool, and the rank as a share of the pool's largest; a pool may have any number of barcodes."""
    r = ranked(qc, [pool], [-F.col("n_count"), F.col("barcode")])
    return r.withColumns({"umi_rank": F.col("_rank").cast("int"), "umi_rank_pct": F.col("_rank") / F.col("_m")}).drop("_rank", "_m", "_part")


def flag_barcodes(qc: DataFrame, n_count: float, n_feature: float, complexity: float, rb: float, mt: float, marker: float | None = None, caps: DataFrame | None = None, called: bool = False) -> DataFrame:
    """F15. tag NotOutlier where all bounds hold; a null metric fails. Optional: at least ``marker`` counts of the marker gene, a rank of at
    most the pool's ``cap`` (pool, cap), and the flag ``is_cell`` of the cell caller."""
    ok = (
        (F.col("n_count") >= n_count) & (F.col("n_feature") >= n_feature) & (F.col("complexity") <= complexity)
        & (F.col("percent_rb") <= rb) & (F.col("percent_mt") <= mt)
    )
    if marker is not None:
        ok = ok & (F.col("marker") >= marker)
    if caps is not None:
        qc = qc.join(caps.select("pool", F.col("cap").alias("_cap")), "pool", "left")
        ok = ok & (F.col("umi_rank") <= F.col("_cap"))
    if called:
        ok = ok & F.col("is_cell")
    return qc.withColumn("tag", F.when(ok, "NotOutlier").otherwise("Outlier")).drop("_cap")


#: A2. Samples that are none.
NO_SAMPLE = ("doublet", "unassigned", "")


def passing_cells(cells: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """A2. Singlets of a sample and a type, in the state that ``wanted`` names by column (tag, ancestry, treatment)."""
    out = cells.where("droplet = 'singlet' AND cell_type IS NOT NULL").where(~F.col("sample").cast("string").isin(*NO_SAMPLE))
    for column, value in (wanted or {}).items():
        out = out.where(F.col(column) == value)
    return out


def pseudobulk(counts: DataFrame, cells: DataFrame, by: list[str], how: str = "sum", wanted: dict[str, str] | None = None) -> DataFrame:
    """A2. Sums by sample, type and gene over the passing cells, which are filtered before the join; ``mean`` divides by all passing cells
    of the group, absent counts being 0."""
    passing = passing_cells(cells, wanted).select("barcode", *by)
    sums = counts.join(passing, "barcode").groupBy(*by, "gene").agg(F.sum("cnt").alias("value"))
    if how == "sum":
        return sums
    n = passing.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(n, by).withColumn("value", F.col("value") / F.col("_n")).drop("_n")


def pseudobulk_stats(cells: DataFrame, by: list[str]) -> DataFrame:
    """A3. Cells of each group, and how many pass."""
    return cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if(F.col("droplet") == "singlet").alias("n_singlet"))


def pseudobulk_funnel(cells: DataFrame, ancestry: str, untreated: str = "UT") -> DataFrame:
    """A3. By pool, sample and type: cells of the pool, the sample and the group, those that meet each single criterion (singlet, NotOutlier,
    ancestry, treatment), and all of them. A sample without any type has no row."""
    named = cells.where(~F.col("sample").cast("string").isin(*NO_SAMPLE))
    tests = {"n_singlet": F.col("droplet") == "singlet", "n_pass_qc": F.col("tag") == "NotOutlier", "n_ancestry": F.col("ancestry") == ancestry, "n_treatment": F.col("treatment") == untreated}
    every = F.col("droplet").eqNullSafe("singlet") & F.col("tag").eqNullSafe("NotOutlier") & F.col("ancestry").eqNullSafe(ancestry) & F.col("treatment").eqNullSafe(untreated)
    g = named.where("cell_type IS NOT NULL").groupBy("pool", "sample", "cell_type").agg(F.count(F.lit(1)).alias("n_group"), *(F.count_if(c).alias(k) for k, c in tests.items()), F.count_if(every).alias("n_cells"))
    pool = cells.groupBy("pool").agg(F.count(F.lit(1)).alias("n_pool"))
    sample = named.groupBy("pool", "sample").agg(F.count(F.lit(1)).alias("n_sample"))
    return g.join(sample, ["pool", "sample"]).join(pool, "pool")


def select_samples(stats: DataFrame, min_cells: int) -> DataFrame:
    """A5. More than min_cells, then each sample's dataset with most cells, the first name on ties."""
    best = F.min_by(F.struct("dataset", "n_cells"), F.struct(-F.col("n_cells"), "dataset"))
    return stats.where(F.col("n_cells") > min_cells).groupBy("sample").agg(best.alias("b")).select("sample", "b.*")


def gte_links(selected: DataFrame, with_dataset: bool = True) -> DataFrame:
    """A5. The links (genotype_id, expression_id, dataset) of the samples that were selected; without dataset, all of one named NA."""
    return selected.select(F.col("sample").alias("genotype_id"), F.col("sample").alias("expression_id"), (F.col("dataset").cast("string") if with_dataset else F.lit("NA")).alias("dataset"))


def summarise_stats(stats: DataFrame) -> DataFrame:
    """A6. Cells by dataset and type with totals."""
    return stats.rollup("dataset", "cell_type").agg(F.sum("n_cells").alias("n_cells"))


def cell_counts(cells: DataFrame, by: tuple[str, ...] = ("pool",)) -> DataFrame:
    """A12. Cells by pool (or dataset) and type, and their share of the pool; droplets that are no singlet have the droplet type."""
    c = cells.withColumn("kind", F.when(F.col("droplet") == "singlet", F.col("cell_type")).otherwise(F.col("droplet")))
    c = c.groupBy(*by, "kind").agg(F.count("*").alias("n"))
    return c.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def droplet_counts(cells: DataFrame) -> DataFrame:
    """A12. Cells by droplet type over all, by dataset, and by dataset and pool, in one pass."""
    keys = ["droplet", "dataset", "pool"]
    return cells.groupingSets([[F.col("droplet")], [F.col("droplet"), F.col("dataset")], [F.col(k) for k in keys]], *keys).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def mad_thresholds(df: DataFrame, value: str, by: list[str], k: list[float]) -> DataFrame:
    """A13. Median and 1.4826 * MAD, and median +- k MAD, by exact selection over ranges, so a group may have any size."""
    med = quantiles(df, value, by, {"median": 0.5})
    far = same(df.select(*by, value), med, by).select(*by, "median", F.abs(F.col(value) - F.col("median")).alias("_far"))
    mad = quantiles(far, "_far", [*by, "median"], {"_mad": 0.5}).select(*by, "median", (F.lit(1.4826) * F.col("_mad")).alias("mad"))
    out = mad.withColumn("k", F.explode(F.array(*map(F.lit, k))))
    return out.withColumns({"lower": F.col("median") - F.col("k") * F.col("mad"), "upper": F.col("median") + F.col("k") * F.col("mad")})


def threshold_to_mad(df: DataFrame, value: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """A13, inverse. How many MADs from the median each cutoff lies, to four places; null where the MAD is 0."""
    one = mad_thresholds(df, value, by, [0.0]).drop("k", "lower", "upper")
    out = one.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return out.withColumn("k", F.round(F.try_divide(F.col("threshold") - F.col("median"), F.col("mad")), 4))


def expression_summary(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """A8. By type, sample and gene: sum, cells that express it, all cells of the group and their share."""
    n = cells.groupBy("cell_type", "sample").agg(F.count("*").alias("n_cells"))
    x = counts.join(cells.select("barcode", "cell_type", "sample"), "barcode").groupBy("cell_type", "sample", "gene")
    x = x.agg(F.sum("cnt").alias("counts"), F.count_if(F.col("cnt") > 0).alias("n_expressed")).join(n, ["cell_type", "sample"])
    return x.withColumn("perc_expressed", F.round(100.0 * F.col("n_expressed") / F.col("n_cells"), 2))


def reaggregate(summary: DataFrame, by: list[str]) -> DataFrame:
    """A8. A summary by sample summed to ``by``, and its share of expressing cells anew."""
    x = summary.groupBy(*by, "gene").agg(F.sum("counts").alias("counts"), F.sum("n_expressed").alias("n_expressed"))
    n = summary.select("cell_type", "sample", "n_cells", *(c for c in by if c not in ("cell_type", "sample"))).distinct().groupBy(*by).agg(F.sum("n_cells").alias("n_cells"))
    return x.join(n, by).withColumn("perc_expressed", F.round(100.0 * F.col("n_expressed") / F.col("n_cells"), 2))
