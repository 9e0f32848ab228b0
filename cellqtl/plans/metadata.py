"""Queries of joins, tallies and unions of cell, donor and sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as M
from .registry import query
from .views import view


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _parts(spark, d):
    c = view(spark, d, "v_cells")
    donors = view(spark, d, "v_donors").select("sample", "dataset", "ancestry")
    return c.select("barcode", "pool", "sample"), c.where("droplet = 'singlet'").select("barcode", "pool", "droplet"), c.where("pool > 1993").select("barcode", "cell_type"), donors


_META = """SELECT c.barcode, c.pool, c.sample, c.droplet, CASE WHEN c.pool > 1993 THEN c.cell_type END AS cell_type, n.dataset, n.ancestry FROM v_cells c LEFT JOIN v_donors n ON c.sample = n.sample WHERE c.droplet = 'singlet'"""


@query("j1_build_cell_metadata", _META)
def j1(spark, d):
    return M.build_cell_metadata(*_parts(spark, d))


@query("j2_attach_barcode_qc", "SELECT barcode, sample, CAST(SUM(cnt) AS BIGINT) AS n_count FROM v_cells JOIN v_counts USING (barcode) GROUP BY barcode, sample")
def j2(spark, d):
    qc = view(spark, d, "v_counts").groupBy("barcode").agg(F.sum("cnt").alias("n_count"))
    return M.attach_barcode_qc(view(spark, d, "v_cells").select("barcode", "sample"), qc)


@query("j11_sample_overlap", """SELECT sample, sample IN (SELECT sample FROM v_genotypes) AS in_vcf, sample IN (SELECT sample FROM v_expr) AS in_expr, TRUE AS in_gte FROM v_donors
UNION SELECT sample, FALSE, TRUE, FALSE FROM v_expr WHERE sample NOT IN (SELECT sample FROM v_donors)""", whole=("v_genotypes", "v_genotypes_all"))
def j11(spark, d, genotypes="v_genotypes"):
    pick = lambda n: view(spark, d, n).select("sample").distinct()
    return M.sample_overlap({"gte": pick("v_donors"), "vcf": pick(genotypes), "expr": pick("v_expr")})


@query("j14_barcode_sources", "SELECT barcode, bool_or(s = 1) AS in_all, bool_or(s = 2) AS in_open FROM (SELECT barcode, 1 AS s FROM v_cells UNION ALL SELECT barcode, 2 FROM v_counts_open) x GROUP BY barcode")
def j14(spark, d):
    return M.barcode_sources(view(spark, d, "v_cells"), view(spark, d, "v_counts_open"), "barcode", ("all", "open"))


@query("j15_rekey_metadata", "SELECT b.barcode, COALESCE(CAST(c.sample AS VARCHAR), 'NA') AS sample, COALESCE(c.cell_type, 'NA') AS cell_type FROM (SELECT DISTINCT barcode FROM v_calls) b LEFT JOIN v_cells c ON b.barcode = c.barcode")
def j15(spark, d):
    return M.rekey_metadata(view(spark, d, "v_calls").select("barcode").distinct(), view(spark, d, "v_cells").select("barcode", "sample", "cell_type"))


@query("j16_demux_match_rate", """SELECT pool, COUNT(*) AS total, SUM(CASE WHEN tool_b <> 'view' THEN 1 ELSE 0 END)::BIGINT AS assigned, SUM(CASE WHEN tool_a = tool_b THEN 1 ELSE 0 END)::BIGINT AS matched,
ROUND(100.0 * SUM(CASE WHEN tool_a = tool_b THEN 1 ELSE 0 END) / COUNT(*), 6) AS pct_total, ROUND(100.0 * SUM(CASE WHEN tool_a = tool_b THEN 1 ELSE 0 END) / NULLIF(SUM(CASE WHEN tool_b <> 'view' THEN 1 ELSE 0 END), 0), 6) AS pct_assigned FROM v_calls GROUP BY pool""")
def j16(spark, d):
    c = view(spark, d, "v_calls")
    return _round(M.demux_match_rate(c.select("barcode", "pool", F.col("tool_a").alias("call")), c.select("barcode", F.col("tool_b").alias("call")), "view"), "pct_total", "pct_assigned")


@query("f21_consensus_droplet_type", "SELECT barcode, CASE WHEN tool_a <> 'click' AND tool_b <> 'click' THEN 'singlet' ELSE 'doublet' END AS droplet FROM v_calls")
def f21(spark, d):
    t = lambda c: F.when(F.col(c) == "click", "doublet").otherwise("singlet").alias(c)
    return M.consensus_droplet_type(view(spark, d, "v_calls").select("barcode", t("tool_a"), t("tool_b")), "tool_a", "tool_b").select("barcode", "droplet")


@query("a4_merge_pools", "SELECT sample, cell_type, gene, CAST(SUM(cnt) AS BIGINT) AS value FROM v_counts JOIN v_cells USING (barcode) GROUP BY sample, cell_type, gene")
def a4(spark, d):
    per_pool = view(spark, d, "v_counts").join(view(spark, d, "v_cells"), "barcode").groupBy("pool", "sample", "cell_type", "gene").agg(F.sum("cnt").alias("value"))
    return M.merge_pools(per_pool, ["sample", "cell_type", "gene"], ["value"])


_CELLS = "SELECT dataset, cell_type, droplet, COUNT(*) AS n_cells FROM v_cells JOIN v_donors USING (sample) GROUP BY dataset, cell_type, droplet"


@query("a7_settings_grid", f"""SELECT cell_type, droplet, CAST(SUM(CASE WHEN dataset = 'BUILDING' THEN n_cells END) AS BIGINT) AS "BUILDING", CAST(SUM(CASE WHEN dataset = 'MACHINERY' THEN n_cells END) AS BIGINT) AS "MACHINERY",
CAST(SUM(CASE WHEN dataset IN ('BUILDING', 'MACHINERY') THEN n_cells ELSE 0 END) AS BIGINT) AS total FROM ({_CELLS}) x GROUP BY cell_type, droplet""")
def a7(spark, d):
    s = view(spark, d, "v_cells").join(view(spark, d, "v_donors").select("sample", "dataset"), "sample").groupBy("dataset", "cell_type", "droplet").agg(F.count("*").alias("n_cells"))
    return M.settings_grid(s, ["cell_type", "droplet"], ["BUILDING", "MACHINERY"])


@query("a11_confusion_all_columns", """SELECT "column", label_a, label_b, n, ROUND(n / SUM(n) OVER (PARTITION BY "column", label_a), 6) AS of_a, ROUND(n / SUM(n) OVER (PARTITION BY "column", label_b), 6) AS of_b FROM
(SELECT 'cell_type' AS "column", a.cell_type AS label_a, b.cell_type AS label_b, COUNT(*) AS n FROM v_cells a JOIN v_cells b ON b.barcode = a.barcode + 1 GROUP BY 2, 3
UNION ALL SELECT 'droplet', a.droplet, b.droplet, COUNT(*) FROM v_cells a JOIN v_cells b ON b.barcode = a.barcode + 1 GROUP BY 2, 3) x""")
def a11(spark, d):
    c = view(spark, d, "v_cells").select("barcode", "cell_type", "droplet")
    return _round(M.confusion_all_columns(c, c.withColumn("barcode", F.col("barcode") - 1), ["barcode"], ["cell_type", "droplet"]), "of_a", "of_b")


@query("a14_cell_filter_funnel", """SELECT cell_type, COUNT(*) AS input, COUNT(*) FILTER (droplet = 'singlet') AS singlet, COUNT(*) FILTER (droplet = 'singlet' AND n_count >= 60) AS umi,
COUNT(*) FILTER (droplet = 'singlet' AND n_count >= 60 AND n_feature >= 4) AS features FROM v_cells LEFT JOIN (SELECT barcode, SUM(cnt) AS n_count, COUNT(*) AS n_feature FROM v_counts GROUP BY barcode) q USING (barcode) GROUP BY cell_type""")
def a14(spark, d):
    qc = view(spark, d, "v_counts").groupBy("barcode").agg(F.sum("cnt").alias("n_count"), F.count("*").alias("n_feature"))
    steps = {"singlet": F.col("droplet") == "singlet", "umi": F.col("n_count") >= 60, "features": F.col("n_feature") >= 4}
    return M.cell_filter_funnel(view(spark, d, "v_cells").join(qc, "barcode", "left"), steps, ["cell_type"])


@query("a16_qtl_results_overview", """SELECT flag, COUNT(DISTINCT gene) AS n_genes, COUNT(*) FILTER (length(alleles) = 3) AS n_snps, ROUND(AVG(n), 1) AS mean_n, COUNT(*) FILTER (p < 0.05) AS n_p FROM v_effects JOIN (SELECT snp, alleles FROM v_variants) v USING (snp) GROUP BY flag""")
def a16(spark, d):
    return M.qtl_results_overview(view(spark, d, "v_effects").join(view(spark, d, "v_variants").select("snp", "alleles"), "snp"), ["flag"], ["p"], 0.05)


@query("a18_average_read_count", "SELECT ROUND(AVG(w), 6) AS average FROM (SELECT SUM(cnt) AS w FROM v_counts GROUP BY barcode) x")
def a18(spark, d):
    return _round(M.average_read_count(view(spark, d, "v_counts").groupBy("barcode").agg(F.sum("cnt").alias("weight"))), "average")


@query("a23_filter_log_tally", """SELECT reason, chr, COUNT(*) AS n FROM (SELECT 1 + snp % 22 AS chr, unnest([CASE WHEN p < 0.5 THEN 'other' END, CASE WHEN p >= 0.5 AND beta <= 0 THEN 'CR' END, CASE WHEN p >= 0.5 AND p <= 0.6 THEN 'MAF' END,
CASE WHEN p >= 0.5 AND n > 1 AND n <= 10 THEN 'HWE' END]) AS reason FROM v_effects) y WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason, chr), (reason))""")
def a23(spark, d):
    values = F.concat(F.lit("CR="), F.col("beta"), F.lit(";MAF="), F.col("p"), F.lit(";HWE="), F.when(F.col("n") == 1, -1).otherwise(F.col("n")))
    log = view(spark, d, "v_effects").select((1 + F.col("snp") % 22).alias("chr"), F.when(F.col("p") < 0.5, "other").otherwise("prefilter").alias("reason"), values.alias("values"))
    return M.filter_log_tally(log, 0, 0.6, 10)


@query("a24_samples_per_celltype", "SELECT cell_type, COUNT(DISTINCT sample) AS n_samples, COUNT(*) AS n_cells FROM v_cells WHERE droplet = 'singlet' GROUP BY cell_type")
def a24(spark, d):
    return M.samples_per_celltype(view(spark, d, "v_cells").where("droplet = 'singlet'"))


@query("a25_matrix_identity", """SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN COALESCE(x.cnt, 0) = COALESCE(y.cnt, 0) THEN 1.0 ELSE 0.0 END), 6) AS identical FROM
(SELECT * FROM v_counts WHERE barcode IN (SELECT barcode FROM v_counts_open) AND gene IN (SELECT gene FROM v_counts_open)) x FULL JOIN v_counts_open y ON x.barcode = y.barcode AND x.gene = y.gene""")
def a25(spark, d):
    return _round(M.matrix_identity(view(spark, d, "v_counts"), view(spark, d, "v_counts_open")), "identical")


@query("w7_gene_batches", "SELECT gene, CAST((ROW_NUMBER() OVER (ORDER BY chr, chr_start, gene) - 1) // 100 AS BIGINT) AS batch FROM v_genes")
def w7(spark, d):
    return M.gene_batches(view(spark, d, "v_genes"), 100).select("gene", "batch")


@query("w8_exclude_duplicate_donors", """SELECT sample, pool AS dataset FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY n DESC, pool) AS r FROM (SELECT sample, pool, COUNT(*) AS n FROM v_cells GROUP BY sample, pool) x WHERE pool <> 1995) y WHERE r > 1
UNION SELECT sample, pool FROM v_cells WHERE pool = 1995""")
def w8(spark, d):
    s = view(spark, d, "v_cells").groupBy("sample", F.col("pool").alias("dataset")).agg(F.count("*").alias("n_cells"))
    return M.exclude_duplicate_donors(s, s.where("dataset = 1995"))


@query("u1_combine_datasets", "SELECT barcode, sample, NULL::INTEGER AS pool, 'cells' AS dataset FROM v_cells UNION ALL SELECT NULL, sample, pool, 'donors' FROM v_donors")
def u1(spark, d):
    return M.combine_datasets({"cells": view(spark, d, "v_cells").select("barcode", "sample"), "donors": view(spark, d, "v_donors").select("sample", "pool")})


@query("u2_combine_expression", "SELECT gene, sample, value FROM v_dense WHERE gene IN (SELECT gene FROM v_dense GROUP BY gene HAVING COUNT(*) = (SELECT COUNT(DISTINCT sample) FROM v_dense))")
def u2(spark, d):
    e = view(spark, d, "v_dense")
    return M.combine_expression([e.where("sample < 20"), e.where("sample >= 20")], e.select("sample").distinct().count())


@query("u2_combine_expression_all", "SELECT gene, sample, value FROM v_tall WHERE gene IN (SELECT gene FROM v_tall GROUP BY gene HAVING COUNT(*) = (SELECT COUNT(DISTINCT sample) FROM v_tall))")
def u2_all(spark, d):
    e = view(spark, d, "v_tall")
    return M.combine_expression([e.where("sample < 6"), e.where("sample >= 6")], e.select("sample").distinct().count())


@query("u3_merge_covariates", "SELECT sample, covariate, value FROM (SELECT sample, unnest(['dataset', 'type']) AS covariate, unnest([dataset, c]) AS value FROM v_donors JOIN (SELECT sample, MIN(cell_type) AS c FROM v_cells GROUP BY sample) x USING (sample)) y")
def u3(spark, d):
    a = view(spark, d, "v_donors").select("sample", F.lit("dataset").alias("covariate"), F.col("dataset").alias("value"))
    b = view(spark, d, "v_cells").groupBy("sample").agg(F.min("cell_type").alias("value")).select("sample", F.lit("type").alias("covariate"), "value")
    return M.merge_covariates([a, b])


@query("u4_merge_vcfs", """SELECT snp, CASE WHEN sample % 20 = 0 THEN 'x_' || sample ELSE CAST(sample AS VARCHAR) END AS sample, dosage FROM v_genotypes WHERE snp % 2 = 0
UNION ALL SELECT snp, 'y_' || sample, dosage FROM v_genotypes WHERE snp % 2 = 1 AND sample % 20 = 0""")
def u4(spark, d):
    g = view(spark, d, "v_genotypes")
    return M.merge_genotypes({"x": g.where("snp % 2 = 0"), "y": g.where("snp % 2 = 1 AND sample % 20 = 0")}).select("snp", "sample", "dosage")


@query("u4_merge_vcfs_all", """SELECT snp, CASE WHEN k = 1 THEN CAST(sample AS VARCHAR) WHEN snp % 2 = 0 THEN 'x_' || sample ELSE 'y_' || sample END AS sample, dosage
FROM v_genotypes_all JOIN (SELECT sample, COUNT(DISTINCT snp % 2) AS k FROM v_genotypes_all GROUP BY sample) n USING (sample)""")
def u4_all(spark, d):
    g = view(spark, d, "v_genotypes_all")
    return M.merge_genotypes({"x": g.where("snp % 2 = 0"), "y": g.where("snp % 2 <> 0")}).select("snp", "sample", "dosage")


@query("u5_dataset_covariate", "SELECT sample, 'dataset' AS covariate, dataset AS value FROM v_donors")
def u5(spark, d):
    return M.dataset_covariate(view(spark, d, "v_donors").withColumnRenamed("sample", "expression_id"))
