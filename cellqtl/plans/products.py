"""Queries of block products, cis association and order statistics over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import expression as X
from ..operators import genetics as G
from ..operators import matrix as M
from ..operators import metadata as N
from ..operators.replication import Study, replicate, titrated
from ..sources import tables as T
from ..sources.effects import source_specs
from ..sources.scratch import scratch_path
from .registry import quantile_sql, query
from .statistics import _SCALED_PI0, _published, _t_p
from .views import view


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("h14_all_genes", """WITH w AS (SELECT barcode, cell_type, 1 + barcode % 3 AS w FROM v_cells), x AS (SELECT cell_type, barcode, gene, cnt AS x, w FROM v_counts JOIN w USING (barcode) WHERE cnt <> 0),
k AS (SELECT cell_type, gene FROM x GROUP BY cell_type, gene HAVING COUNT(*) >= 12), t AS (SELECT cell_type, SUM(w) AS sw FROM w GROUP BY cell_type), y AS (SELECT x.* FROM x JOIN k USING (cell_type, gene)),
m AS (SELECT cell_type, gene, SUM(w * x) / sw AS mean, SUM(w * x * x) / sw - (SUM(w * x) / sw) * (SUM(w * x) / sw) AS var, sw FROM y JOIN t USING (cell_type) GROUP BY cell_type, gene, sw),
c AS (SELECT a.cell_type, a.gene AS gene_a, b.gene AS gene_b, SUM(a.w * a.x * b.x) AS xy FROM y a JOIN y b ON a.cell_type = b.cell_type AND a.barcode = b.barcode AND a.gene > b.gene GROUP BY 1, 2, 3)
SELECT a.cell_type, a.gene AS gene_a, b.gene AS gene_b, CASE WHEN a.var > 1e-14 AND b.var > 1e-14 THEN ROUND((COALESCE(xy, 0) / a.sw - a.mean * b.mean) / sqrt(a.var * b.var), 6) + 0 END AS r
FROM m a JOIN m b ON a.cell_type = b.cell_type AND a.gene > b.gene LEFT JOIN c ON c.cell_type = a.cell_type AND c.gene_a = a.gene AND c.gene_b = b.gene""")
def h14_all(spark, d):
    """Every gene that 12 cells of a type express, against every other."""
    cells = view(spark, d, "v_cells").select("barcode", "cell_type", (1 + F.col("barcode") % 3).alias("weight"))
    return _round(M.weighted_gene_correlation(view(spark, d, "v_counts"), cells, "cell_type", 12), "r").withColumn("r", F.col("r") + 0.0)


_TESTS = """WITH l AS (SELECT DISTINCT sample, sample % 2 AS dataset FROM v_donors), e AS (SELECT gene, sample, dataset, value FROM v_expr JOIN l USING (sample)),
u AS (SELECT gene, sample, dataset, (RANK() OVER (PARTITION BY dataset, gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY dataset, gene, value) - 1) / 2.0::DOUBLE) / (COUNT(*) OVER (PARTITION BY dataset, gene) + 1) AS u FROM e),
g AS (SELECT snp, sample, dataset, dosage FROM v_genotypes_all JOIN l USING (sample)),
s AS (SELECT dataset, snp, COUNT(*) AS n, COUNT(dosage) AS called, SUM(dosage) / 2 / COUNT(dosage) AS af, COUNT(*) FILTER (dosage = 0) AS n0, COUNT(*) FILTER (dosage = 1) AS n1, COUNT(*) FILTER (dosage = 2) AS n2 FROM g GROUP BY dataset, snp),
w AS (SELECT *, list_transform(range(m % 2, m + 1, 2), lambda h: h * ln(2) - lgamma((m - h) / 2 + 1.0) - lgamma(h + 1.0) - lgamma(n0 + n1 + n2 - h - (m - h) / 2 + 1.0)) AS w, n1 * ln(2) - lgamma((m - n1) / 2 + 1.0) - lgamma(n1 + 1.0) - lgamma(n0 + n2 - (m - n1) / 2 + 1.0) AS o FROM (SELECT *, n1 + 2 * LEAST(n0, n2) AS m FROM s) a),
k AS (SELECT dataset, snp FROM w WHERE LEAST(af, 1 - af) >= 0.3 AND CAST(called AS DOUBLE) / n >= 0.93 AND list_sum(list_transform(list_filter(w, lambda x: x <= o + 1e-9), lambda x: exp(x - o))) / list_sum(list_transform(w, lambda x: exp(x - o))) >= 1e-12),
p AS (SELECT gene, snp, pos - chr_start AS distance FROM v_genes JOIN v_variants USING (chr) WHERE abs(pos - chr_start) <= 1000000)"""


_PAIRS = """SELECT dataset, gene, snp, distance, COUNT(*) AS n, CASE WHEN MIN(dosage) < MAX(dosage) AND MIN(u) < MAX(u) THEN {} END AS r
FROM p JOIN u USING (gene) JOIN k USING (dataset, snp) JOIN g USING (dataset, snp, sample) WHERE dosage IS NOT NULL GROUP BY dataset, gene, snp, distance HAVING COUNT(*) >= {}"""


def _cis(spark, d, min_obs):
    """All genes and variants within a megabase, in two datasets with filters of their own."""
    gte = view(spark, d, "v_donors").select(F.col("sample").alias("genotype_id"), F.col("sample").alias("expression_id"), (F.col("sample") % 2).alias("dataset"))
    genes = view(spark, d, "v_genes").select("gene", "chr", F.col("chr_start").alias("tss"))
    return A.cis_association(view(spark, d, "v_genotypes_all"), view(spark, d, "v_expr"), gte, genes, view(spark, d, "v_variants"), maf=0.3, call=0.93, hwe=1e-12, min_obs=min_obs)


@query("h19_cis_window", f"{_TESTS} {_PAIRS.format(f'ROUND(corr({quantile_sql("u")}, dosage), 6) + 0', 3)}")
def h19_window(spark, d):
    """Pairs, sizes and r; ``h19_cis_association`` has p and z, too."""
    return _round(_cis(spark, d, 3).drop("p", "z"), "r").withColumn("r", F.col("r") + 0.0)


@query("h19_cis_association", f"""{_TESTS} SELECT dataset, gene, snp, distance, n, ROUND(r, 6) + 0 AS r, ROUND(p, 6) AS p, ROUND(sign(r) * -({quantile_sql('(greatest(p, 1e-300) / 2)')}), 4) + 0 AS z
FROM (SELECT *, {_t_p('r', 'n')} AS p FROM (SELECT * REPLACE (CASE WHEN abs(r) > 1 - 1e-12 THEN sign(r) ELSE r END AS r) FROM ({_PAIRS.format(f"corr({quantile_sql('u')}, dosage)", 2)}) c) t) s""")
def h19(spark, d):
    found = _cis(spark, d, 2).withColumns({"r": F.round("r", 6) + 0.0, "p": F.round("p", 6), "z": F.round("z", 4) + 0.0})
    return found.select("dataset", "gene", "snp", "distance", "n", "r", "p", "z")


#: A source as its owner would declare it: other names, versions of genes, a variant that holds place and alleles, sizes that follow from allele counts.
_DECLARED = json.dumps({
    "gene_id": [["feature", "(G[0-9]+)\\.", ""]], "position": [["variant", "([0-9]+)_", ":"], ["variant", "[0-9]+_([0-9]+)_", ""]],
    "alleles": [["variant", "[0-9]+_[0-9]+_([A-Z]+)_", "/"], ["variant", "[0-9]+_[0-9]+_[A-Z]+_([A-Z]+)", ""]], "ea": "tested", "beta": "slope", "beta_se": "slope_se", "p": "pval_nominal", "mac": "ma_count", "maf": "freq",
})


def _studies(spark, d):
    """Three sources of their own shapes: one that is published, one declared in JSON, with other gene names, and one with its own rate and few columns."""
    published = _published(spark, d).drop("qval")
    declared = view(spark, d, "v_study", "R").select(
        F.concat(F.lit("G"), "gene", F.lit(".2")).alias("feature"), F.concat(F.lit("1_"), F.col("snp") * 10, F.when(F.col("ea") == "A", "_A_G").otherwise("_G_A")).alias("variant"), F.col("ea").alias("tested"),
        F.col("beta").cast("string").alias("slope"), F.col("beta_se").cast("string").alias("slope_se"), F.col("p").cast("string").alias("pval_nominal"), F.concat("n", F.lit(".0")).alias("ma_count"), F.lit("0.25").alias("freq"),
    )
    few = view(spark, d, "v_study", "N").select(F.concat(F.lit("ENSG"), "gene").alias("gene"), F.concat(F.lit("1:"), F.col("snp") * 10).alias("snp"), "ea", F.col("beta").alias("b"), F.col("p").alias("pv"), F.least(F.lit(1.0), F.col("p") * 2).alias("rate"))
    plain = lambda **c: {k: [(v, None, "")] for k, v in c.items()}
    names = view(spark, d, "v_genes").select(F.concat(F.lit("G"), "gene").alias("short"), F.concat(F.lit("ENSG"), "gene").alias("long"))
    specs, n = G.load_column_specs(_DECLARED)
    return [
        Study("published", published, source_specs("meta_analysis", published)),
        Study("declared", declared, specs, n, names),
        Study("few", few, plain(gene_id="gene", position="snp", ea="ea", beta="b", p="pv", fdr="rate"), 100),
    ]


_RUNS = f"""WITH e AS (SELECT 'published' AS study, 'ENSG' || gene AS gene, '1:' || snp * 10 AS snp, p * 1.5 AS p, beta, ea, NULL::DOUBLE AS own FROM v_study WHERE flag = 'A' AND p * 1.5 <= 1
UNION ALL SELECT 'declared', 'ENSG' || gene, '1:' || snp * 10, p, beta, ea, NULL FROM v_study WHERE flag = 'R' UNION ALL SELECT 'few', 'ENSG' || gene, '1:' || snp * 10, p, beta, ea, LEAST(1.0, p * 2) FROM v_study WHERE flag = 'N'),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY study, gene ORDER BY p, snp) AS r FROM e) x WHERE r = 1),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY study ORDER BY p) AS k, COUNT(*) OVER (PARTITION BY study) AS m FROM t),
f AS (SELECT *, COALESCE(own, LEAST(1.0, MIN(p * m / k) OVER (PARTITION BY study ORDER BY k DESC ROWS UNBOUNDED PRECEDING))) AS fdr FROM k),
o AS (SELECT f.study AS disc, n.study AS repl, f.gene, f.snp, f.p, f.fdr, f.beta, e.p AS repl_p, CASE WHEN f.ea <> e.ea THEN -e.beta ELSE e.beta END AS repl_beta FROM f JOIN (SELECT DISTINCT study FROM e) n ON n.study <> f.study LEFT JOIN e ON e.study = n.study AND e.gene = f.gene AND e.snp = f.snp),
s AS (SELECT disc, repl, gene, m2, LEAST(1.0, MIN(repl_p * m2 / k2) OVER (PARTITION BY disc, repl ORDER BY k2 DESC ROWS UNBOUNDED PRECEDING)) AS rate FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY disc, repl ORDER BY repl_p) AS k2, COUNT(*) OVER (PARTITION BY disc, repl) AS m2 FROM o WHERE fdr <= 0.6 AND repl_beta IS NOT NULL) b),
u AS (SELECT o.*, CASE WHEN m2 > 1 THEN rate END AS repl_fdr FROM o LEFT JOIN s USING (disc, repl, gene))"""


@query("h18_from_sources", f"""{_RUNS}, v AS (SELECT *, unnest(CASE WHEN repl_fdr <= 0.6 AND fdr <= 0.6 THEN ['all', 'disc', 'both'] WHEN fdr <= 0.6 THEN ['all', 'disc'] ELSE ['all'] END) AS subset FROM u WHERE repl_beta IS NOT NULL),
b AS (SELECT disc, repl, subset, COUNT(*) AS n, CASE WHEN COUNT(*) > 1 AND MIN(beta) < MAX(beta) AND MIN(repl_beta) < MAX(repl_beta) THEN corr(beta, repl_beta) END AS r, 100.0 * AVG(CASE WHEN beta * repl_beta > 0 THEN 1.0 ELSE 0.0 END) AS ac FROM v GROUP BY disc, repl, subset),
h AS (SELECT disc, repl, 1 - LEAST(1.0, {_SCALED_PI0}) AS pi1 FROM (SELECT *, MAX(repl_p) OVER (PARTITION BY disc, repl) AS top_p FROM v WHERE subset = 'disc') q GROUP BY disc, repl)
SELECT disc, repl, subset, n, ROUND(r, 6) AS r, ROUND({_t_p('r', 'n')}, 5) AS p, ROUND(ac, 6) AS ac, ROUND(CASE WHEN subset = 'disc' THEN pi1 END, 6) AS pi1 FROM b LEFT JOIN h USING (disc, repl)""")
def h18_sources(spark, d):
    """From three sources to the statistics of all six pairs. Rb and standard errors are tested against brute force."""
    s = replicate(_studies(spark, d), 0.6)[1]
    return _round(s, "r", "ac", "pi1").select("disc", "repl", "subset", "n", "r", F.round("p", 5).alias("p"), "ac", "pi1")


@query("h18_source_pairs", f"{_RUNS} SELECT disc, repl, gene, snp, ROUND(fdr, 6) AS fdr, ROUND(repl_fdr, 6) AS repl_fdr, ROUND(repl_beta, 6) + 0 AS repl_beta FROM u")
def h18_source_pairs(spark, d):
    pairs = replicate(_studies(spark, d), 0.6)[0].select("disc", "repl", "gene", "snp", "fdr", "repl_fdr", "repl_beta")
    return _round(pairs, "fdr", "repl_fdr", "repl_beta").withColumn("repl_beta", F.col("repl_beta") + 0.0)


_QC = "v_cells LEFT JOIN (SELECT barcode, SUM(cnt) AS n_count, COUNT(*) AS n_feature FROM v_counts GROUP BY barcode) q USING (barcode)"


@query("a14_threshold_grid", f"""SELECT cell_type, at_features, at_low, at_high, COUNT(*) AS input, COUNT(*) FILTER (droplet = 'singlet') AS singlet, COUNT(*) FILTER (droplet = 'singlet' AND n_feature >= at_features) AS features,
COUNT(*) FILTER (droplet = 'singlet' AND n_feature >= at_features AND n_count >= at_low) AS low, COUNT(*) FILTER (droplet = 'singlet' AND n_feature >= at_features AND n_count >= at_low AND n_count <= at_high) AS high,
COUNT(*) FILTER (droplet = 'singlet' AND n_feature >= at_features AND n_count >= at_low AND n_count <= at_high AND pool > 1993) AS late
FROM {_QC}, (SELECT unnest([1.0::DOUBLE, 3, 5]) AS at_features) a, (SELECT unnest([20.0::DOUBLE, 60, 90]) AS at_low) b, (SELECT unnest([120.0::DOUBLE, 200]) AS at_high) c GROUP BY cell_type, at_features, at_low, at_high""")
def a14_grid(spark, d):
    qc = view(spark, d, "v_counts").groupBy("barcode").agg(F.sum("cnt").alias("n_count"), F.count("*").alias("n_feature"))
    count, feature = F.col("n_count"), F.col("n_feature")
    steps = {"singlet": F.col("droplet") == "singlet", "features": (feature, "min", [1, 3, 5]), "low": (count, "min", [20, 60, 90]), "high": (count, "max", [120, 200]), "late": F.col("pool") > 1993}
    return N.threshold_grid(view(spark, d, "v_cells").join(qc, "barcode", "left"), steps, ["cell_type"])


_PAIRED = """SELECT flag, column_a, column_b, x, y FROM (SELECT flag, unnest(['p', 'p', 'n', 'n']) AS column_a, unnest(['beta', 'z', 'beta', 'z']) AS column_b, unnest([p, p, n, n]) AS x, unnest([beta, z, beta, z]) AS y FROM
(SELECT flag, CASE WHEN gene % 5 > 0 THEN p END AS p, CAST(n AS DOUBLE) AS n, CASE WHEN snp % 4 > 0 THEN beta END AS beta, z FROM v_study) a) b WHERE x IS NOT NULL AND y IS NOT NULL"""


def _columns(spark, d, method):
    e = view(spark, d, "v_study")
    a = e.select("flag", "gene", "snp", F.when(F.col("gene") % 5 > 0, F.col("p")).alias("p"), "n")
    b = e.select("flag", "gene", "snp", F.when(F.col("snp") % 4 > 0, F.col("beta")).alias("beta"), "z")
    return _round(X.correlations_by_dataset(a.withColumnRenamed("flag", "dataset").withColumn("flag", F.col("dataset")), b, ["flag", "gene", "snp"], ["p", "n"], ["beta", "z"], ["dataset"], method), "r").withColumn("r", F.col("r") + 0.0).drop("p")


@query("h17_by_dataset", f"SELECT flag AS dataset, column_a, column_b, COUNT(*) AS n, ROUND(corr(x, y), 6) + 0 AS r FROM ({_PAIRED}) q GROUP BY ALL")
def h17_dataset(spark, d):
    """Two tables with gaps of their own: every pair of columns over the rows that have both."""
    return _columns(spark, d, "pearson")


_RANK_OF = "RANK() OVER (PARTITION BY flag, column_a, column_b ORDER BY {0}) + (COUNT(*) OVER (PARTITION BY flag, column_a, column_b, {0}) - 1) / 2.0::DOUBLE"


@query("h17_spearman", f"SELECT flag AS dataset, column_a, column_b, COUNT(*) AS n, ROUND(corr(u, v), 6) + 0 AS r FROM (SELECT *, {_RANK_OF.format('x')} AS u, {_RANK_OF.format('y')} AS v FROM ({_PAIRED}) q) w GROUP BY flag, column_a, column_b")
def h17_spearman(spark, d):
    return _columns(spark, d, "spearman")


@query("a21_titrated_replication", """WITH e AS (SELECT n % 4 AS n_pcs, flag AS cell_type, gene, snp, p, beta, ea FROM v_study),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_pcs, cell_type, gene ORDER BY p, snp) AS r FROM e) x WHERE r = 1), k AS (SELECT *, ROW_NUMBER() OVER w AS k, COUNT(*) OVER (PARTITION BY n_pcs, cell_type) AS m FROM t WINDOW w AS (PARTITION BY n_pcs, cell_type ORDER BY p)),
f AS (SELECT *, LEAST(1.0, MIN(p * m / k) OVER (PARTITION BY n_pcs, cell_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM k)
SELECT f.n_pcs, f.cell_type AS disc, e.cell_type AS repl, COUNT(*) AS n, ROUND(100.0 * AVG(CASE WHEN f.beta * CASE WHEN f.ea <> e.ea THEN -e.beta ELSE e.beta END > 0 THEN 1.0 ELSE 0.0 END), 6) AS ac
FROM f JOIN e ON e.n_pcs = f.n_pcs AND e.gene = f.gene AND e.snp = f.snp AND e.cell_type <> f.cell_type WHERE f.fdr <= 0.9 GROUP BY 1, 2, 3""")
def a21_titrated(spark, d):
    """All pairs of cell types at each number of components; r, pi1 and Rb are those of A19."""
    e = view(spark, d, "v_study").select((F.col("n") % 4).alias("n_pcs"), F.col("flag").alias("cell_type"), "gene", "snp", "p", "beta", "ea")
    return _round(titrated(e, 0.9), "ac").select("n_pcs", "disc", "repl", "n", "ac")


@query("s2_unlike_headers", "SELECT CAST(gene AS VARCHAR) AS gene, CAST(snp AS VARCHAR) AS snp, CASE WHEN flag <> 'R' THEN ea END AS ea, CASE WHEN flag = 'N' THEN CAST(n AS VARCHAR) END AS n FROM v_study")
def s2_unlike(spark, d):
    """Three shards of other headers: columns in another order, one missing, one more."""
    path = scratch_path(spark, "shards")
    e = view(spark, d, "v_study").select("flag", *(F.col(c).cast("string").alias(c) for c in ("gene", "snp", "ea", "n")))
    for flag, columns in {"A": ["gene", "snp", "ea"], "R": ["snp", "gene"], "N": ["n", "ea", "gene", "snp"]}.items():
        e.where(F.col("flag") == flag).select(columns).write.csv(f"{path}/CT={flag}", sep="\t", header=True)
    return T.read_sharded(spark, path + "/CT=<CT>", {"CT": ["A", "R", "N", "missing"]}).select("gene", "snp", "ea", "n")


@query("h13_target_depth", "SELECT barcode, gene, cnt, ROUND(ln(1 + cnt * 10000.0 / s), 6) AS fit FROM v_counts JOIN (SELECT barcode, CAST(SUM(cnt) AS DOUBLE) AS s FROM v_counts GROUP BY barcode) x USING (barcode)")
def h13_target(spark, d):
    return _round(X.proportional_fit(view(spark, d, "v_counts"), True, 10_000), "fit")


@query("h8_oriented", """SELECT CAST(sample AS VARCHAR) AS sample, 'intercept' AS "column", 1.0::DOUBLE AS value FROM v_donors WHERE sample IN (SELECT sample FROM v_expr) UNION ALL SELECT CAST(sample AS VARCHAR), 'pool', CAST(pool AS DOUBLE) FROM v_donors WHERE sample IN (SELECT sample FROM v_expr)""")
def h8_oriented(spark, d):
    """Covariates whose rows and columns are exchanged against the matrix."""
    cov = view(spark, d, "v_donors").select(F.lit("pool").alias("sample"), F.col("sample").cast("string").alias("covariate"), F.col("pool").cast("string").alias("value"))
    return M.design_matrix(M.oriented(cov, view(spark, d, "v_expr").select("sample")))


@query("f12_filter_genotypes", """SELECT snp, sample, dosage FROM v_genotypes_all WHERE sample IN (SELECT sample FROM v_donors WHERE dataset = 'BUILDING') AND snp IN
(SELECT snp FROM (SELECT snp, COUNT(dosage) AS called, COUNT(*) AS n, SUM(dosage) / 2 / COUNT(dosage) AS af FROM v_genotypes_all GROUP BY snp) x WHERE CAST(called AS DOUBLE) / n >= 0.965 AND LEAST(af, 1 - af) >= 0.48)""")
def f12_genotypes(spark, d):
    g = view(spark, d, "v_genotypes_all")
    return G.filter_genotypes(g, G.variant_stats(g), {"call": 0.965, "maf": 0.48}, samples=view(spark, d, "v_donors").where("dataset = 'BUILDING'"))


@query("f1_joined_dictionary", "SELECT symbol || '/' || gene AS gene, CAST(snp AS VARCHAR) AS snp, p, symbol || '/' || gene || '_' || snp AS key FROM v_effects JOIN (SELECT gene, MIN(symbol) AS symbol FROM v_genes GROUP BY gene) g USING (gene)")
def f1_joined(spark, d):
    """A dictionary with an entry for each gene, as a table."""
    words = view(spark, d, "v_genes").select(F.col("gene").alias("key"), F.col("symbol").alias("value"))
    return G.standardize(view(spark, d, "v_effects"), {"gene": [("gene", words, "/"), ("gene", None, "")], "snp": [("snp", None, "")], "p": [("p", None, "")]}, ["p"], ["p"])
