"""One query for each operator, on inputs derived from the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cells as C
from ..operators import compare as X
from ..operators import effects as E
from .registry import QUERIES, SQL, quantile_sql, query as _query
from .views import deltas, view

def _effects(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    return view(spark, d, "v_effects", flag).drop("flag") if flag else view(spark, d, "v_effects")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _qc(spark: SparkSession, d: str) -> DataFrame:
    return C.barcode_qc(view(spark, d, "v_counts"), view(spark, d, "v_genes"))


@_query("a1_barcode_qc", """SELECT barcode, CAST(n_count AS BIGINT) AS n_count, n_feature, CAST(rb AS BIGINT) AS rb, CAST(mt AS BIGINT) AS mt, ROUND(100.0 * n_feature / n_count, 6) AS complexity,
ROUND(100.0 * rb / n_count, 6) AS percent_rb, ROUND(100.0 * mt / n_count, 6) AS percent_mt FROM (SELECT barcode, SUM(cnt) AS n_count, COUNT(*) AS n_feature, COALESCE(SUM(CASE WHEN is_rb THEN cnt END), 0) AS rb,
COALESCE(SUM(CASE WHEN is_mt THEN cnt END), 0) AS mt FROM v_counts JOIN v_genes USING (gene) GROUP BY barcode) q""")
def a1(spark, d):
    return _round(_qc(spark, d), "complexity", "percent_rb", "percent_mt")


@_query("w1_umi_rank", """SELECT barcode, pool, CAST(n_count AS BIGINT) AS n_count, r AS umi_rank, ROUND(r / MAX(r) OVER (PARTITION BY pool), 6) AS umi_rank_pct FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY n_count DESC, barcode) AS r FROM (SELECT barcode, SUM(cnt) AS n_count FROM v_counts GROUP BY barcode) x JOIN (SELECT DISTINCT barcode, pool FROM v_cells) c USING (barcode)) y""")
def w1(spark, d):
    total = view(spark, d, "v_counts").groupBy("barcode").agg(F.sum("cnt").alias("n_count"))
    return _round(C.umi_rank(total.join(view(spark, d, "v_cells").select("barcode", "pool").distinct(), "barcode"), "pool"), "umi_rank_pct")


@_query("f15_flag_barcodes", """SELECT barcode, CASE WHEN n_count >= 50 AND n_feature >= 2 AND 100.0 * n_feature / n_count <= 8 AND 100.0 * rb / n_count <= 50 AND 100.0 * mt / n_count <= 50 THEN 'NotOutlier' ELSE 'Outlier' END AS tag
FROM (SELECT barcode, SUM(cnt) AS n_count, COUNT(*) AS n_feature, COALESCE(SUM(CASE WHEN is_rb THEN cnt END), 0) AS rb, COALESCE(SUM(CASE WHEN is_mt THEN cnt END), 0) AS mt FROM v_counts JOIN v_genes USING (gene) GROUP BY barcode) q""")
def f15(spark, d):
    return C.flag_barcodes(_qc(spark, d), 50, 2, 8, 50, 50).select("barcode", "tag")


@_query("a2_pseudobulk", "SELECT sample, cell_type, gene, CAST(SUM(cnt) AS BIGINT) AS value FROM v_counts JOIN v_cells USING (barcode) WHERE droplet = 'singlet' AND sample IS NOT NULL AND cell_type IS NOT NULL GROUP BY sample, cell_type, gene")
def a2(spark, d):
    return C.pseudobulk(view(spark, d, "v_counts"), view(spark, d, "v_cells"), ["sample", "cell_type"])


@_query("a3_pseudobulk_stats", "SELECT sample, cell_type, COUNT(*) AS n_cells, CAST(SUM(CASE WHEN droplet = 'singlet' THEN 1 ELSE 0 END) AS BIGINT) AS n_singlet FROM v_cells GROUP BY sample, cell_type")
def a3(spark, d):
    return C.pseudobulk_stats(view(spark, d, "v_cells"), ["sample", "cell_type"])


@_query("a5_select_samples", """SELECT sample, dataset, n_cells FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY n_cells DESC, dataset) AS r FROM
(SELECT sample, pool AS dataset, COUNT(*) AS n_cells FROM v_cells GROUP BY sample, pool) s WHERE n_cells > 1) t WHERE r = 1""")
def a5(spark, d):
    stats = view(spark, d, "v_cells").groupBy("sample", F.col("pool").alias("dataset")).agg(F.count("*").alias("n_cells"))
    return C.select_samples(stats, 1)


@_query("a6_summarise_stats", "SELECT dataset, cell_type, CAST(SUM(n_cells) AS BIGINT) AS n_cells FROM (SELECT pool AS dataset, cell_type, COUNT(*) AS n_cells FROM v_cells GROUP BY pool, cell_type) s GROUP BY ROLLUP (dataset, cell_type)")
def a6(spark, d):
    return C.summarise_stats(view(spark, d, "v_cells").groupBy(F.col("pool").alias("dataset"), "cell_type").agg(F.count("*").alias("n_cells")))


@_query("a8_expression_summary", """SELECT cell_type, sample, gene, counts, n_expressed, n_cells, ROUND(100.0 * n_expressed / n_cells, 2) AS perc_expressed FROM
(SELECT cell_type, sample, gene, CAST(SUM(cnt) AS BIGINT) AS counts, COUNT(*) AS n_expressed FROM v_counts JOIN v_cells USING (barcode) WHERE cnt > 0 GROUP BY cell_type, sample, gene) x
JOIN (SELECT cell_type, sample, COUNT(*) AS n_cells FROM v_cells GROUP BY cell_type, sample) n USING (cell_type, sample)""")
def a8(spark, d):
    return C.expression_summary(view(spark, d, "v_counts"), view(spark, d, "v_cells"))


@_query("a12_cell_counts", """SELECT pool, kind, n, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY pool), 6) AS pct FROM
(SELECT pool, CASE WHEN droplet = 'singlet' THEN cell_type ELSE droplet END AS kind, COUNT(*) AS n FROM v_cells GROUP BY 1, 2) x""")
def a12(spark, d):
    return _round(C.cell_counts(view(spark, d, "v_cells")), "pct")


@_query("a13_mad_thresholds", """SELECT dataset, cell_type, ROUND(m, 6) AS median, ROUND(a, 6) AS mad, k, ROUND(m - k * a, 6) AS lower, ROUND(m + k * a, 6) AS upper FROM
(SELECT dataset, cell_type, m, 1.4826 * median(abs(feature - m)) AS a FROM v_qc JOIN (SELECT dataset, cell_type, median(feature) AS m FROM v_qc GROUP BY dataset, cell_type) x USING (dataset, cell_type) GROUP BY dataset, cell_type, m) y
CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS DOUBLE) AS k) z""")
def a13(spark, d):
    return _round(C.mad_thresholds(view(spark, d, "v_qc"), "feature", ["dataset", "cell_type"], [1.0, 2.0, 3.0]), "median", "mad", "lower", "upper")


@_query("w3_top_effects", """SELECT gene, flag, snp, p, beta, ea, n, n_entries FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene ORDER BY p, snp, flag) AS r, COUNT(*) OVER (PARTITION BY gene) AS n_entries FROM v_effects) x WHERE r = 1""")
def w3(spark, d):
    return E.top_effects(_effects(spark, d), ties=("snp", "flag"))


@_query("j3_lookup_effects", "SELECT gene, snp, p, beta, ea, n FROM v_effects WHERE flag = 'R' AND (gene, snp) IN (SELECT (gene, snp) FROM v_effects WHERE flag = 'A' AND p < 0.05)")
def j3(spark, d):
    return E.lookup_effects(_effects(spark, d, "R"), _effects(spark, d, "A").where("p < 0.05"))


_OVERLAP = """SELECT a.gene, a.snp, a.p, a.ea, a.n, a.beta, r.p AS repl_p, COALESCE(a.ea <> r.ea, FALSE) AS flipped,
CASE WHEN COALESCE(a.ea <> r.ea, FALSE) THEN -r.beta ELSE r.beta END AS repl_beta
FROM (SELECT * FROM v_effects WHERE flag = 'A') a LEFT JOIN (SELECT * FROM v_effects WHERE flag = 'R') r ON a.gene = r.gene AND a.snp = r.snp"""


@_query("j4_overlap_effects", _OVERLAP)
def j4(spark, d):
    return E.overlap_effects(_effects(spark, d, "A"), _effects(spark, d, "R")).select("gene", "snp", "p", "ea", "n", "beta", "repl_p", "flipped", "repl_beta")


@_query("a19_replication_stats", f"""SELECT subset, COUNT(*) AS n, ROUND(corr(beta, repl_beta), 6) AS r, ROUND(100.0 * AVG(CASE WHEN beta * repl_beta > 0 THEN 1.0 ELSE 0.0 END), 6) AS ac FROM
(SELECT *, unnest(CASE WHEN p <= 0.5 AND repl_p <= 0.5 THEN ['all', 'disc', 'both'] WHEN p <= 0.5 THEN ['all', 'disc'] ELSE ['all'] END) AS subset FROM ({_OVERLAP}) o WHERE repl_beta IS NOT NULL) s GROUP BY subset""")
def a19(spark, d):
    return _round(E.replication_stats(E.overlap_effects(_effects(spark, d, "A"), _effects(spark, d, "R")), 0.5), "r", "ac").select("subset", "n", "r", "ac")


@_query("w4_drop_duplicates", "SELECT gene, snp, flag FROM (SELECT *, COUNT(*) OVER (PARTITION BY gene, snp) AS k FROM v_effects) x WHERE k = 1")
def w4(spark, d):
    return E.drop_duplicates(_effects(spark, d), ["gene", "snp"], "all").select("gene", "snp", "flag")


@_query("w9_bh_fdr", """SELECT flag, gene, snp, ROUND(LEAST(1.0, MIN(p * m / r) OVER (PARTITION BY flag ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM
(SELECT flag, gene, snp, p, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY p) AS r, COUNT(*) OVER (PARTITION BY flag) AS m FROM v_effects) x""")
def w9(spark, d):
    return _round(E.bh_fdr(_effects(spark, d), "p", ["flag"]).select("flag", "gene", "snp", "fdr"), "fdr")


@_query("h5_bonferroni", "SELECT flag, gene, snp, ROUND(LEAST(1.0, p * n), 9) AS bonferroni FROM v_effects")
def h5(spark, d):
    return E.bonferroni(_effects(spark, d), "p", "n").select("flag", "gene", "snp", F.round("bonferroni", 9).alias("bonferroni"))


@_query("f14_filter_significant", "SELECT flag, gene, snp, p FROM v_effects WHERE p < 0.05")
def f14(spark, d):
    return E.filter_significant(_effects(spark, d), "p", 0.05).select("flag", "gene", "snp", "p")


@_query("j9_cis_pairs", "SELECT g.chr, gene, tss, snp, pos, pos - tss AS distance FROM (SELECT gene, chr, chr_start AS tss FROM v_genes) g JOIN (SELECT snp, chr, pos FROM v_variants) v ON g.chr = v.chr AND abs(pos - tss) <= 1000000")
def j9(spark, d):
    genes = view(spark, d, "v_genes").select("gene", "chr", F.col("chr_start").alias("tss"))
    return E.cis_pairs(genes, view(spark, d, "v_variants").select("snp", "chr", "pos"))


@_query("f9_sort_alleles", "SELECT snp, array_to_string(list_sort(string_split(alleles, '/')), '/') AS alleles FROM v_variants")
def f9(spark, d):
    return view(spark, d, "v_variants").select("snp", S.sort_alleles(F.col("alleles")).alias("alleles"))


@_query("f19_variant_type", "SELECT snp, CASE WHEN length(alleles) = 3 THEN 'SNP' WHEN length(alleles) <= 2 THEN NULL ELSE 'INDEL' END AS kind FROM v_variants")
def f19(spark, d):
    return view(spark, d, "v_variants").select("snp", S.variant_type(F.col("alleles")).alias("kind"))


@_query("f10_log_modulus", "SELECT flag, gene, snp, ROUND(sign(beta) * ln(abs(beta) + 1), 6) AS lm FROM v_effects")
def f10(spark, d):
    return _effects(spark, d).select("flag", "gene", "snp", F.round(S.log_modulus(F.col("beta")), 6).alias("lm"))


@_query("f7_pvalue_to_zscore", f"SELECT flag, gene, snp, ROUND(CASE WHEN beta > 0 THEN -({quantile_sql('(p / 2)')}) ELSE {quantile_sql('(p / 2)')} END, 6) + 0 AS z FROM v_effects")
def f7(spark, d):
    return _effects(spark, d).select("flag", "gene", "snp", (F.round(S.pvalue_to_zscore(F.col("p"), F.col("beta")), 6) + 0.0).alias("z"))


@_query("f8_zscore_to_beta", """SELECT flag, gene, snp, ROUND(z / sqrt(2 * 0.2::DOUBLE * (1 - 0.2::DOUBLE) * (n + z * z)), 6) AS b, ROUND(1 / sqrt(2 * 0.2::DOUBLE * (1 - 0.2::DOUBLE) * (n + z * z)), 6) AS se FROM (SELECT *, beta * 100 AS z FROM v_effects) x""")
def f8(spark, d):
    b, se = S.zscore_to_beta(F.col("beta") * 100, F.lit(0.2), F.col("n"))
    return _effects(spark, d).select("flag", "gene", "snp", F.round(b, 6).alias("b"), F.round(se, 6).alias("se"))


@_query("j7_count_delta", "SELECT a.barcode, a.gene, a.cnt, COALESCE(b.cnt, 0) AS cnt_b, a.cnt - COALESCE(b.cnt, 0) AS delta FROM v_counts a LEFT JOIN v_counts_open b ON a.barcode = b.barcode AND a.gene = b.gene")
def j7(spark, d):
    return deltas(spark, d)


@_query("a9_delta_summary", """SELECT gene, CAST(SUM(cnt) AS BIGINT) AS a, CAST(SUM(cb) AS BIGINT) AS b, CAST(SUM(cnt - cb) AS BIGINT) AS delta, ROUND(SUM(cnt - cb) / CAST(GREATEST(SUM(cnt), SUM(cb)) AS DOUBLE), 6) AS delta_pct FROM
(SELECT a.gene, a.cnt, COALESCE(b.cnt, 0) AS cb FROM v_counts a LEFT JOIN v_counts_open b ON a.barcode = b.barcode AND a.gene = b.gene) x GROUP BY gene""")
def a9(spark, d):
    return _round(X.delta_summary(j7(spark, d), "gene"), "delta_pct")


@_query("a10_confusion_matrix", 'SELECT tool_b AS "row", tool_a AS col, n, ROUND(n / SUM(n) OVER (PARTITION BY tool_b), 6) AS fraction FROM (SELECT tool_a, tool_b, COUNT(*) AS n FROM v_calls GROUP BY tool_a, tool_b) x')
def a10(spark, d):
    return _round(X.confusion_matrix(view(spark, d, "v_calls"), "tool_a", "tool_b"), "fraction")


@_query("a15_exclusive_overlap", "SELECT combination, COUNT(*) AS n FROM (SELECT gene, array_to_string(list_sort(list(DISTINCT flag)), '+') AS combination FROM v_effects GROUP BY gene) x GROUP BY combination")
def a15(spark, d):
    return X.exclusive_overlap(_effects(spark, d), "gene", "flag")


@_query("j8_combine_tool_calls", "SELECT barcode, pool, COALESCE(MAX(CASE WHEN dataset = 'click' THEN v END), 'unknown') AS call_click, COALESCE(MAX(CASE WHEN dataset = 'view' THEN v END), 'unknown') AS call_view FROM (SELECT cell_type AS barcode, barcode % 97 AS pool, dataset, CASE WHEN feature > 50 THEN 'singlet' ELSE 'doublet' END AS v FROM v_qc) x GROUP BY barcode, pool")
def j8(spark, d):
    q = view(spark, d, "v_qc").select(F.col("cell_type").alias("barcode"), (F.col("barcode") % 97).alias("pool"), "dataset", F.when(F.col("feature") > 50, "singlet").otherwise("doublet").alias("v"))
    return X.combine_tool_calls(q, ["barcode", "pool"], "dataset", "v", ["click", "view"])


@_query("w11_quantile_bins", "SELECT dataset, " + ", ".join(f"ROUND(quantile_cont(feature, {i / 4}), 6) AS edge_{i}" for i in range(5)) + " FROM v_qc GROUP BY dataset")
def w11(spark, d):
    return _round(X.quantile_bins(view(spark, d, "v_qc"), "feature", ["dataset"], 4), *(f"edge_{i}" for i in range(5)))


@_query("a26_qc_metric_limits", "SELECT MIN(feature) AS low, MAX(feature) AS high, ROUND(median(feature), 6) AS median, ROUND(MIN(CASE WHEN cell_type > 0 THEN feature END), 2) AS low_ok, ROUND(MAX(CASE WHEN cell_type > 0 THEN feature END), 2) AS high_ok FROM v_qc")
def a26(spark, d):
    q = view(spark, d, "v_qc").withColumn("tag", F.when(F.col("cell_type") > 0, "NotOutlier").otherwise("Outlier"))
    return _round(X.qc_metric_limits(q, "feature", "tag"), "median")


def entry_query(spark: SparkSession, d: str) -> DataFrame:
    """Pseudobulk expression per donor and cell type of the barcodes that pass quality control."""
    tags = C.flag_barcodes(_qc(spark, d), 50, 2, 8, 50, 50).where("tag = 'NotOutlier'").select("barcode")
    return C.pseudobulk(view(spark, d, "v_counts"), view(spark, d, "v_cells").join(tags, "barcode", "left_semi"), ["sample", "cell_type"])
