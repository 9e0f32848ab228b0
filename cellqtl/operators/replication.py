"""Replication between studies, from tables as their sources write them to the statistics of all pairs of studies, as one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .effects import drop_duplicates, overlap_effects, replication_rates, replication_stats
from .genetics import fill_missing_stats, standardize_all, translate_genes
from .ranking import bh_fdr, qvalues

#: What a study brings into the comparison; a column that it lacks is null.
TEXT = ["gene", "snp", "alleles", "ea", "oa"]
VALUES = ["beta", "beta_se", "z", "p", "n", "af", "maf", "fdr"]


@dataclass(frozen=True)
class Study:
    """A source: its table (all columns as written), the specs of its columns (F2 or F3), its sample size where no column has
    one, and a table (of two columns) that translates its gene names."""

    name: str
    table: DataFrame
    specs: dict[str, list]
    n: int | None = None
    genes: DataFrame | None = None


def prepared(study: Study, gene: str = "gene_id", snp: str = "position", infer: bool = True, duplicates: str = "allbutfirst") -> DataFrame:
    """study and the columns of TEXT and VALUES of one study: fields by its specs (F4), gene names translated (F5), what follows from other fields
    filled in (F6), and one row per gene and variant (W4: the one of least p, unless ``duplicates`` says all or none)."""
    out = standardize_all(study.table, study.specs, gene, snp)
    if study.genes is not None:
        source, target = study.genes.columns
        names = translate_genes(out.select(F.col("gene").alias(source)).distinct(), study.genes, source, target)
        out = out.withColumnRenamed("gene", "_source").join(names.select(F.col(source).alias("_source"), F.col(target).alias("gene")).where("gene is not null"), "_source").drop("_source")
    out = fill_missing_stats(out, infer, study.n)
    order = ["p", *(c for c in ("ea", "beta") if c in out.columns)]
    held = lambda c, kind: (F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c)
    chosen = drop_duplicates(out, ["gene", "snp"], duplicates, order)
    return chosen.select(F.lit(study.name).alias("study"), *(held(c, "string") for c in TEXT), *(held(c, "double") for c in VALUES), F.lit("fdr" in out.columns).alias("_own"))


def titrated(effects: DataFrame, alpha: float, by: str = "n_pcs", of: str = "cell_type") -> DataFrame:
    """A21, its second part. by, disc, repl, n, r, p, ac, pi1 (and Rb with standard errors): for each number of components, and each cell type as discovery against every
    other one of the same number, the statistics (A19) over top effects that are significant in discovery. ``effects``: by, of, gene, snp, p, beta, ea. All
    settings are keys of one job."""
    rest = [c for c in effects.columns if c not in (by, of, "gene")]
    best = effects.where("p is not null").groupBy(by, of, "gene").agg(F.min_by(F.struct(*rest), F.struct("p", "snp")).alias("_b"))
    top = bh_fdr(best.select(by, F.col(of).alias("disc"), "gene", "_b.*"), "p", [by, "disc"], "fdr")
    other = effects.select(by, F.col(of).alias("repl"), "gene", "snp", *(F.col(c).alias(f"repl_{c}") for c in rest if c != "snp"))
    found = top.join(other, [by, "gene", "snp"]).where("disc <> repl")
    turned = found.withColumn("repl_beta", F.when(F.col("ea") != F.col("repl_ea"), -F.col("repl_beta")).otherwise(F.col("repl_beta")))
    stats = replication_stats(written(turned, "titrated"), alpha, "fdr", "repl_p", (by, "disc", "repl"))
    return stats.where("subset = 'disc'").drop("subset")


def replicate(studies: list[Study], alpha: float, fdr: str = "bh", gene: str = "gene_id", snp: str = "position", infer: bool = True, duplicates: str = "allbutfirst") -> tuple[DataFrame, DataFrame]:
    """H18. (pairs, statistics) of every study as discovery against every other as replication. A discovery's top effect of each gene (W3) is looked up in
    the other studies (J3, J4: alleles must agree where both studies have them, effects are turned to discovery's effect allele). Discovery's
    rate is its own or is computed over its top effects; the replication's rate is computed over pairs that are significant in
    discovery and found, two at least. ``fdr``: qvalues, bh or none. Pairs of studies are a key of the rows, not jobs of their own."""
    if len({s.name for s in studies}) < len(studies):
        raise ValueError("studies need names of their own")
    rate = {"bh": bh_fdr, "qvalues": qvalues, "none": lambda df, c, by, name: df.withColumn(name, F.col(c))}[fdr]
    effects = written(reduce(DataFrame.unionByName, (prepared(s, gene, snp, infer, duplicates) for s in studies)), "effects")
    rest = [c for c in effects.columns if c not in ("study", "gene")]
    best = effects.where("p is not null").groupBy("study", "gene").agg(F.min_by(F.struct(*rest), F.struct("p", "snp")).alias("_b"), F.count(F.lit(1)).alias("n_entries"))
    top = rate(best.select("study", "gene", "_b.*", "n_entries"), "p", ["study"], "_rate")
    top = top.withColumn("fdr", F.when(F.col("_own"), F.col("fdr")).otherwise(F.col("_rate"))).drop("_own", "_rate").withColumnRenamed("study", "disc")
    names = F.array(*(F.lit(s.name) for s in studies))
    wanted = top.withColumn("repl", F.explode(F.filter(names, lambda n: n != F.col("disc"))))
    found = overlap_effects(wanted, effects.drop("fdr", "_own").withColumnRenamed("study", "repl"), by=("repl",))
    tested = F.coalesce((F.col("fdr") <= alpha) & F.col("repl_beta").isNotNull(), F.lit(False))
    pairs = written(replication_rates(found.withColumn("_tested", tested), rate, ["disc", "repl"]), "pairs")
    return pairs, replication_stats(pairs, alpha, "fdr", "repl_fdr", ("disc", "repl"))
