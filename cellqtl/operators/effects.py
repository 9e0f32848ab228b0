"""QTL summary statistics: top effects, overlap of studies, multiple testing, cis pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import beta_threshold, correlation_p
from ..functions.scalars import correlation, sort_alleles
from ..sources.scratch import written
from .genetics import rb_by
from .ranking import bh_fdr, fdr_rates, pi1, qvalues, same

#: Genes of one task of :func:`cis_pairs`.
GENES = 10_000


def top_effects(effects: DataFrame, gene: str = "gene", p: str = "p", ties: tuple[str, ...] = ("snp",)) -> DataFrame:
    """W3. Each gene's row of least p and its number of rows, by an aggregate that combines on the map side."""
    rest = [c for c in effects.columns if c != gene]
    best = F.min_by(F.struct(*rest), F.struct(p, *ties))
    return effects.groupBy(gene).agg(best.alias("b"), F.count("*").alias("n_entries")).select(gene, "b.*", "n_entries")


def lookup_effects(effects: DataFrame, wanted: DataFrame) -> DataFrame:
    """J3. The rows of the wanted (gene, snp) pairs."""
    return effects.join(wanted.select("gene", "snp").distinct(), ["gene", "snp"], "left_semi")


def lookup_counts(effects: DataFrame, wanted: DataFrame) -> DataFrame:
    """J3. One row: wanted pairs, those found, those of a gene that has no row at all, and those of which the gene alone is there."""
    pairs = wanted.select("gene", "snp").distinct()
    near = effects.select("gene", "snp").join(pairs.select("gene").distinct(), "gene", "left_semi")
    both, gene = near.distinct().withColumn("_pair", F.lit(True)), near.select("gene").distinct().withColumn("_gene", F.lit(True))
    j = pairs.join(both, ["gene", "snp"], "left").join(gene, "gene", "left")
    seen, known = F.col("_pair").isNotNull(), F.col("_gene").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("wanted"), F.count_if(seen).alias("found"), F.count_if(~known).alias("missing_gene"), F.count_if(known & ~seen).alias("missing_pair"))


def overlap_effects(disc: DataFrame, repl: DataFrame, effects: tuple[str, ...] = ("beta", "z"), by: tuple[str, ...] = ()) -> DataFrame:
    """J4. Left join on gene, snp and, where both tables have them, the sorted alleles. With runs ``by``, on these too, and alleles have to agree
    where both rows have them. The replication's columns get ``repl_`` in front. Where the effect alleles differ, its effects are turned and its allele frequency is that of the other allele; then its
    alleles are discovery's. A pair without an effect on its side is not turned."""
    keys = [*by, "gene", "snp"]
    r = repl.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"repl_{c}") for c in repl.columns if c not in (*keys, "alleles")), *([sort_alleles(F.col("alleles")).alias("_other")] if "alleles" in repl.columns else []))
    on = [disc[k] == r[f"_k{i}"] for i, k in enumerate(keys)]
    if "alleles" in disc.columns and "alleles" in repl.columns:
        own, other = sort_alleles(disc["alleles"]), r["_other"]
        on.append((own == other) | (own == "") | (other == "") if by else own == other)  # empty: not known
    there = [c for c in effects if f"repl_{c}" in r.columns]
    flip = F.coalesce((F.col("ea") != F.col("repl_ea")) & reduce(Column.__or__, (F.col(f"repl_{c}").isNotNull() for c in there)), F.lit(False))
    out = disc.join(r, on, "left").drop(*(f"_k{i}" for i in range(len(keys))), "_other").withColumn("flipped", flip)
    turned = {f"repl_{c}": F.when(F.col("flipped"), -F.col(f"repl_{c}")).otherwise(F.col(f"repl_{c}")) for c in there}
    if "repl_af" in r.columns:
        turned["repl_af"] = F.when(F.col("flipped"), 1 - F.col("repl_af")).otherwise(F.col("repl_af"))
    if "oa" in disc.columns:
        turned |= {"repl_oa": F.col("oa"), "repl_ea": F.col("ea")}
    elif "repl_oa" in r.columns:
        turned |= {"repl_oa": F.when(F.col("flipped"), F.col("repl_ea")).otherwise(F.col("repl_oa")), "repl_ea": F.col("ea")}
    return out.withColumns(turned)


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """H4. by, n, r, p: Pearson's correlation of the pairs of each group and its two-sided p value (t with n - 2 degrees of freedom)."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
    return g.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def replication_stats(overlap: DataFrame, alpha: float, disc: str = "p", repl: str = "repl_p", runs: tuple[str, ...] = ()) -> DataFrame:
    """A19. For all pairs, those significant in discovery (``disc`` at most alpha), and in both, by run: number, Pearson's r and its p,
    allelic concordance in percent (an effect of 0 never agrees), and for the middle row pi1 of the replication's p values and,
    with standard errors at hand, Rb, its standard error and p. Runs are one job, not one job each."""
    found = overlap.where("repl_beta IS NOT NULL")
    subset = F.array_compact(F.array(F.lit("all"), F.when(F.col(disc) <= alpha, "disc"), F.when((F.col(disc) <= alpha) & (F.col(repl) <= alpha), "both")))
    rows, by = found.withColumn("subset", F.explode(subset)), [*runs, "subset"]
    agree = rows.groupBy(*by).agg((F.avg((F.col("beta") * F.col("repl_beta") > 0).cast("double")) * 100).alias("ac"))
    out = same(correlations(rows, "beta", "repl_beta", by), agree, by)
    middle = rows.where("subset = 'disc'")
    out = same(out, pi1(middle, "repl_p", by).drop("m"), by, "left")
    if {"beta_se", "repl_beta_se"} <= set(overlap.columns):
        named = middle.select(*by, *(F.col(c).alias(n) for c, n in zip(("beta", "beta_se", "repl_beta", "repl_beta_se"), ("b1", "se1", "b2", "se2"), strict=True)))
        out = same(out, rb_by(named, by).select(*by, "rb", F.col("se").alias("rb_se"), F.col("p").alias("rb_p")), by, "left")
    return out


def cis_pairs(genes: DataFrame, variants: DataFrame, window: int = 1_000_000) -> DataFrame:
    """J9. Same chromosome and within the window of the gene's start: variants go to one bucket of an eighth of the window's width, genes to
    all that the window touches, so the join is an equality join and few of its rows lie outside. Genes are dealt by chromosome and bucket to a task
    for each ``GENES`` of them, as one small file of genes may have pairs without number."""
    width, tasks = max(1, window // 8), max(1, -(-genes.count() // GENES))
    bucket = lambda at: F.floor(at / width)
    g = genes.withColumn("bucket", F.explode(F.sequence(bucket(F.col("tss") - window), bucket(F.col("tss") + window)))).repartition(tasks, "chr", "bucket")
    near = g.join(variants.withColumn("bucket", bucket(F.col("pos"))), ["chr", "bucket"]).withColumn("distance", F.col("pos") - F.col("tss"))
    return near.where(F.abs("distance") <= window).drop("bucket")


def drop_duplicates(df: DataFrame, key: list[str], mode: str, order: list[str] | None = None, reference: DataFrame | None = None) -> DataFrame:
    """W4. ``all``: no copy of a repeated key stays; ``allbutfirst``: one row per key, of each column the first value in ``order`` that is not
    null; ``mismatched``: of a repeated key those rows whose key and ``ea`` ``reference`` has; ``none``: a repeated key is an error."""
    if mode == "allbutfirst":
        first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
        return df.groupBy(*key).agg(*(first(c).alias(c) for c in df.columns if c not in key)).select(*df.columns)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    counted = df.join(counts, key)
    if mode == "all":
        return counted.where("_n = 1").drop("_n")
    if mode == "mismatched":
        known = reference.select(*key, "ea").distinct().withColumn("_known", F.lit(True))
        return counted.join(known, [*key, "ea"], "left").where("_n = 1 OR _known").select(*df.columns)
    if mode == "none":
        return counted.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    raise ValueError(mode)


def filter_significant(df: DataFrame, column: str, alpha: float) -> DataFrame:
    """F14. Values below alpha, ascending; what is not a number is dropped."""
    value = F.col(column).cast("string").try_cast("double")
    return df.where(value < alpha).orderBy(value)


def bonferroni(df: DataFrame, p: str, n: str) -> DataFrame:
    """H5, its Bonferroni step: p * n, at most 1."""
    return df.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col(n)))


def multiple_testing(top: DataFrame, p: str, alpha: float, by: list[str], n_tests: str | None = None, beta_p: str | None = None, beta: tuple[str, str] | None = None) -> DataFrame:
    """H5. Rows with a nominal p: Bonferroni's p and its BH rate (with ``n_tests``), BH rate and q value of ``beta_p`` (else ``p``), the run's
    threshold midway between the largest p with a q of at most alpha and the smallest above, and with the columns ``beta`` (a, b) the
    nominal threshold of each gene."""
    out, chosen = top.where(F.col(p).isNotNull()), beta_p or p
    if n_tests:
        out = bh_fdr(bonferroni(out, p, n_tests), "bonferroni", by, "bonferroni_bh")
    out = written(fdr_rates(out, chosen, by, "bh", "q"), "rated")
    ends = out.groupBy(*by).agg(F.max(F.when(F.col("q") <= alpha, F.col(chosen))).alias("_lo"), F.min(F.when(F.col("q") > alpha, F.col(chosen))).alias("_hi"))
    out = same(out, ends.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias("p_threshold")), by)
    return out.withColumn("nominal_threshold", beta_threshold("p_threshold", *beta)) if beta else out


def collect_replication_stats(stats: DataFrame, disc: list[str], repl: list[str]) -> DataFrame:
    """A20. One row for each discovery and replication setting of A19's rows: numbers in discovery and in both, the percentage
    replicated, r, concordance, pi1 and Rb of the middle row; a conditional aggregate in place of a self join."""
    of = lambda c, subset: F.max(F.when(F.col("subset") == subset, F.col(c)))
    middle = [c for c in ("r", "ac", "pi1", "rb") if c in stats.columns]
    g = stats.groupBy(*disc, *repl).agg(of("n", "disc").alias("n_disc"), F.coalesce(of("n", "both"), F.lit(0)).alias("n_both"), *(of(c, "disc").alias(c) for c in middle))
    return g.where("n_disc > 0").withColumn("pct_replicated", 100 * F.col("n_both") / F.col("n_disc"))


def replication_matrix(collected: DataFrame, row: str, column: str, names: list, value: str = "pct_replicated") -> DataFrame:
    """A20. The matrix view: a row for each discovery setting, a column for each replication setting."""
    return collected.groupBy(row).pivot(column, names).agg(F.max(value))


def heterogeneity_by_replication(merged: DataFrame, meta: DataFrame, alpha: float) -> DataFrame:
    """J19. I squared and the absolute z of each dataset for every overlapping pair, with its group of significance; ``meta`` has
    gene, snp, i2 and a map ``z`` by dataset. Pairs without I squared are dropped; one row per dataset."""
    x, y = F.col("p") <= alpha, F.coalesce(F.col("repl_p") <= alpha, F.lit(False))
    group = F.when(x & y, "Both").when(x, "Discovery").when(y, "Replication").otherwise("Neither")
    m = meta.where("i2 IS NOT NULL").select("gene", "snp", "i2", "z")
    j = merged.select("gene", "snp", group.alias("signif")).join(m, ["gene", "snp"])
    return j.select("gene", "snp", "signif", "i2", F.explode("z").alias("dataset", "_z")).select("gene", "snp", "signif", "i2", "dataset", F.abs("_z").alias("abs_z"))


def pc_titration(df: DataFrame, by: list[str]) -> DataFrame:
    """A21. Percentage of genes with an effect for each number of components (n_pcs, n_eqtl, n_genes, explained), and the variance explained
    by the components up to it. A row for each number of components of a cell type."""
    w = Window.partitionBy(*by).orderBy("n_pcs").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"pct_eqtl": 100 * F.try_divide(F.col("n_eqtl").cast("double"), F.col("n_genes")), "cum_explained": F.sum("explained").over(w)})


def replication_rates(pairs: DataFrame, rate, runs: list[str]) -> DataFrame:
    """``pairs`` with repl_fdr in place of _tested: the rate of repl_p over the tested rows of a run, two at least. The others, which are most, have none and are
    neither ranked nor joined."""
    marked = written(pairs, "marked")
    tested, rest = marked.where("_tested").drop("_tested"), marked.where("NOT _tested").drop("_tested")
    enough = tested.groupBy(*runs).agg(F.count(F.lit(1)).alias("_n"))
    rated = same(rate(tested, "repl_p", runs, "_rate"), enough, runs).withColumn("repl_fdr", F.when(F.col("_n") > 1, F.col("_rate"))).drop("_n", "_rate")
    return rated.unionByName(rest.withColumn("repl_fdr", F.lit(None).cast("double")))


def replication_pipeline(disc: DataFrame, repl: DataFrame, alpha: float, fdr: str = "bh", p: str = "p", runs: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """H18. (pairs, statistics) of two standardized studies: discovery's top effect of each gene, the replication's rows of those pairs,
    the overlap, discovery's rate over its p values where it has no ``fdr`` of its own, the replication's rate over pairs that are
    significant in discovery and not missing (two at least), and A19. ``fdr``: qvalues, bh or none."""
    rate = {"bh": bh_fdr, "qvalues": qvalues, "none": lambda df, c, by, name: df.withColumn(name, F.col(c))}[fdr]
    gene = [*runs, "gene"]
    best = disc.groupBy(*gene).agg(F.min_by(F.struct(*(c for c in disc.columns if c not in gene)), F.struct(p, "snp")).alias("_b"), F.count(F.lit(1)).alias("n_entries"))
    top = best.select(*gene, "_b.*", "n_entries")
    top = written(top, "top")
    pairs = overlap_effects(top, lookup_effects(repl, top))
    if "fdr" not in pairs.columns:
        pairs = rate(pairs, p, list(runs), "fdr")
    tested = (F.col("fdr") <= alpha) & F.col("repl_beta").isNotNull()
    pairs = replication_rates(pairs.drop("repl_fdr").withColumn("_tested", F.coalesce(tested, F.lit(False))), rate, list(runs))
    pairs = written(pairs, "pairs")
    return pairs, replication_stats(pairs, alpha, "fdr", "repl_fdr", runs)
