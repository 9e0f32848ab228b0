"""Queries of the further forms of cell, sample and comparison operators, and of genotype tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import compare as X
from ..operators import genetics as G
from ..operators import metadata as M
from .registry import query
from .views import deltas, tasks_of, view


def _round(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


@query("a1_marker", """SELECT pool, barcode, CAST(SUM(cnt) AS BIGINT) AS n_count, COUNT(*) AS n_feature, CAST(COALESCE(SUM(CASE WHEN is_rb THEN cnt END), 0) AS BIGINT) AS rb, CAST(COALESCE(SUM(CASE WHEN symbol = (SELECT MIN(p_name) FROM part) THEN cnt END), 0) AS BIGINT) AS marker
FROM v_counts JOIN (SELECT barcode, pool FROM v_cells) c USING (barcode) LEFT JOIN (SELECT * FROM v_genes WHERE gene % 3 > 0) g USING (gene) GROUP BY pool, barcode""")
def a1(spark, d):
    counts = view(spark, d, "v_counts").join(view(spark, d, "v_cells").select("barcode", "pool"), "barcode")
    name = view(spark, d, "v_genes").agg(F.min("symbol")).first()[0]
    return C.barcode_qc(counts, view(spark, d, "v_genes").where("gene % 3 > 0"), name).select("pool", "barcode", "n_count", "n_feature", "rb", "marker")


@query("f15_all_bounds", """WITH q AS (SELECT pool, barcode, SUM(cnt) AS n_count, COUNT(*) AS n_feature, COALESCE(SUM(CASE WHEN gene % 5 = 0 THEN cnt END), 0) AS marker FROM v_counts JOIN (SELECT barcode, pool FROM v_cells) c USING (barcode) GROUP BY pool, barcode),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY n_count DESC, barcode) AS k FROM q)
SELECT barcode, CASE WHEN n_count >= 50 AND n_feature >= 2 AND marker >= 1 AND k <= pool - 1985 AND barcode % 2 = 0 THEN 'NotOutlier' ELSE 'Outlier' END AS tag FROM r""")
def f15(spark, d):
    counts = view(spark, d, "v_counts").join(view(spark, d, "v_cells").select("barcode", "pool"), "barcode")
    genes = view(spark, d, "v_genes").withColumn("symbol", F.when(F.col("gene") % 5 == 0, "MALAT1"))
    qc = C.umi_rank(C.barcode_qc(counts, genes, "MALAT1"), "pool").withColumn("is_cell", F.col("barcode") % 2 == 0)
    caps = view(spark, d, "v_cells").select("pool").distinct().withColumn("cap", F.col("pool") - 1985)
    return C.flag_barcodes(qc, 50, 2, 100, 100, 100, marker=1, caps=caps, called=True).select("barcode", "tag")


_PASS = "droplet = 'singlet' AND tag = 'NotOutlier' AND ancestry = 'EUROPE' AND treatment = 'UT'"


@query("a2_pseudobulk_mean", f"""WITH p AS (SELECT barcode, sample, cell_type FROM v_full WHERE {_PASS}), n AS (SELECT sample, cell_type, COUNT(*) AS k FROM p GROUP BY sample, cell_type)
SELECT sample, cell_type, gene, ROUND(SUM(cnt) / MIN(k), 6) AS value FROM v_counts JOIN p USING (barcode) JOIN n USING (sample, cell_type) GROUP BY sample, cell_type, gene""")
def a2(spark, d):
    wanted = {"tag": "NotOutlier", "ancestry": "EUROPE", "treatment": "UT"}
    return _round(C.pseudobulk(view(spark, d, "v_counts"), view(spark, d, "v_full"), ["sample", "cell_type"], "mean", wanted), "value")


@query("a3_pseudobulk_funnel", f"""SELECT pool, sample, cell_type, MIN(np) AS n_pool, MIN(ns) AS n_sample, COUNT(*) AS n_group, COUNT(*) FILTER (droplet = 'singlet') AS n_singlet, COUNT(*) FILTER (tag = 'NotOutlier') AS n_pass_qc, COUNT(*) FILTER (ancestry = 'EUROPE') AS n_ancestry, COUNT(*) FILTER (treatment = 'UT') AS n_treatment,
COUNT(*) FILTER ({_PASS}) AS n_cells FROM (SELECT *, COUNT(*) OVER (PARTITION BY pool) AS np, COUNT(*) OVER (PARTITION BY pool, sample) AS ns FROM v_full) x GROUP BY pool, sample, cell_type""")
def a3(spark, d):
    return C.pseudobulk_funnel(view(spark, d, "v_full"), "EUROPE")


@query("a5_gte_links", """SELECT sample AS genotype_id, sample AS expression_id, CAST(dataset AS VARCHAR) AS dataset FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY n_cells DESC, dataset) AS r FROM
(SELECT sample, pool AS dataset, COUNT(*) AS n_cells FROM v_cells GROUP BY sample, pool) s WHERE n_cells > 1) t WHERE r = 1""")
def a5(spark, d):
    stats = view(spark, d, "v_cells").groupBy("sample", F.col("pool").alias("dataset")).agg(F.count("*").alias("n_cells"))
    return C.gte_links(C.select_samples(stats, 1))


@query("a8_reaggregate", """WITH c AS (SELECT barcode, cell_type, sample, sample % 20 AS individual FROM v_cells), n AS (SELECT cell_type, individual, COUNT(*) AS n_cells FROM c GROUP BY 1, 2)
SELECT cell_type, individual, gene, CAST(SUM(cnt) AS BIGINT) AS counts, COUNT(*) AS n_expressed, n_cells, ROUND(100.0 * COUNT(*) / n_cells, 2) AS perc_expressed FROM v_counts JOIN c USING (barcode) JOIN n USING (cell_type, individual) GROUP BY cell_type, individual, gene, n_cells""")
def a8(spark, d):
    # individuals whose cells of a type express nothing do not differ here: every cell has counts
    s = C.expression_summary(view(spark, d, "v_counts"), view(spark, d, "v_cells").join(view(spark, d, "v_counts").select("barcode").distinct(), "barcode", "left_semi"))
    out = C.reaggregate(s.withColumn("individual", F.col("sample") % 20), ["cell_type", "individual"])
    n = view(spark, d, "v_cells").groupBy("cell_type", (F.col("sample") % 20).alias("individual")).agg(F.count("*").alias("n_all"))
    return out.join(n, ["cell_type", "individual"]).withColumn("perc_expressed", F.round(100.0 * F.col("n_expressed") / F.col("n_all"), 2)).withColumn("n_cells", F.col("n_all")).drop("n_all")


@query("a12_droplet_counts", "SELECT droplet, dataset, pool, CAST(GROUPING_ID(droplet, dataset, pool) AS BIGINT) AS level, COUNT(*) AS n FROM v_full GROUP BY GROUPING SETS ((droplet), (droplet, dataset), (droplet, dataset, pool))")
def a12(spark, d):
    return C.droplet_counts(view(spark, d, "v_full"))


@query("a13_threshold_to_mad", """SELECT dataset, cell_type, threshold, ROUND((threshold - m) / NULLIF(a, 0), 4) AS k FROM (SELECT dataset, cell_type, m, 1.4826 * median(abs(feature - m)) AS a FROM v_qc JOIN (SELECT dataset, cell_type, median(feature) AS m FROM v_qc GROUP BY dataset, cell_type) x
USING (dataset, cell_type) GROUP BY dataset, cell_type, m) y CROSS JOIN (SELECT CAST(unnest([10, 50]) AS DOUBLE) AS threshold) z""")
def a13(spark, d):
    return C.threshold_to_mad(view(spark, d, "v_qc"), "feature", ["dataset", "cell_type"], [10.0, 50.0]).select("dataset", "cell_type", "threshold", "k")


_DELTA = "SELECT a.barcode, a.gene, a.cnt, a.cnt - COALESCE(b.cnt, 0) AS delta FROM v_counts a LEFT JOIN v_counts_open b ON a.barcode = b.barcode AND a.gene = b.gene"


@query("a9_by_cell_type", f"""SELECT cell_type, COUNT(*) AS n_cells, CAST(SUM(c) AS BIGINT) AS counts, CAST(SUM(l) AS BIGINT) AS delta, CAST(MIN(l) AS BIGINT) AS low, CAST(MAX(l) AS BIGINT) AS high, ROUND(AVG(l), 6) AS mean, ROUND(100.0 * abs(SUM(l)) / SUM(c), 6) AS prop
FROM (SELECT barcode, SUM(cnt) AS c, SUM(delta) AS l FROM ({_DELTA}) x GROUP BY barcode) y JOIN v_cells USING (barcode) GROUP BY cell_type""")
def a9(spark, d):
    return _round(X.delta_by_cell_type(deltas(spark, d), view(spark, d, "v_cells")), "mean", "prop")


@query("a9_by_include", f"SELECT barcode, CAST(COALESCE(SUM(delta) FILTER (gene % 2 = 0), 0) AS BIGINT) AS included, CAST(COALESCE(SUM(delta) FILTER (gene % 2 = 1), 0) AS BIGINT) AS excluded, CAST(SUM(delta) AS BIGINT) AS total FROM ({_DELTA}) x GROUP BY barcode")
def a9_include(spark, d):
    return X.delta_by_include(deltas(spark, d), view(spark, d, "v_genes").where("gene % 2 = 0"), tasks_of(spark.read.parquet(f"{d}/lineitem.parquet")))


_PANEL = "SELECT pool, CASE tool_a WHEN 'click' THEN 'view' ELSE tool_a END AS a, CASE tool_b WHEN 'click' THEN 'view' ELSE tool_b END AS b FROM v_calls"


@query("a10_panels", f'SELECT pool, b AS "row", a AS col, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY pool, b), 6) AS fraction FROM ({_PANEL}) x GROUP BY pool, b, a')
def a10(spark, d):
    return _round(X.confusion_matrix(view(spark, d, "v_calls"), "tool_a", "tool_b", {"click": "view"}, ("pool",)), "fraction")


@query("a10_tpr", f"SELECT pool, CAST(SUM(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS agree, COUNT(*) AS total, ROUND(AVG(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS tpr FROM ({_PANEL}) x WHERE (pool, b) IN (SELECT (pool, a) FROM ({_PANEL}) y) GROUP BY pool")
def a10_tpr(spark, d):
    m = X.confusion_matrix(view(spark, d, "v_calls"), "tool_a", "tool_b", {"click": "view"}, ("pool",))
    return _round(X.true_positive_rate(m, ("pool",)), "tpr")


@query("a15_all_combinations", """WITH h AS (SELECT chr, gene, array_to_string(list_sort(list(DISTINCT flag)), '+') AS combination FROM v_effects JOIN (SELECT gene, chr FROM v_genes) g USING (gene) WHERE flag <> 'N' GROUP BY chr, gene)
SELECT combination, COUNT(gene) AS n FROM (SELECT unnest(['A', 'N', 'R', 'A+N', 'A+R', 'N+R', 'A+N+R']) AS combination) c LEFT JOIN h USING (combination) GROUP BY combination""")
def a15(spark, d):
    e = view(spark, d, "v_effects").where("flag <> 'N'").join(view(spark, d, "v_genes").select("gene", "chr"), "gene")
    return X.all_combinations(X.exclusive_overlap(e, "gene", "flag", ("chr",)), ["A", "N", "R"])


@query("j8_inner", "SELECT barcode, pool, MAX(CASE WHEN dataset = 'click' THEN v END) AS call_click, MAX(CASE WHEN dataset = 'view' THEN v END) AS call_view FROM (SELECT cell_type AS barcode, barcode % 97 AS pool, dataset, CASE WHEN feature > 50 THEN 'singlet' ELSE 'doublet' END AS v FROM v_qc) x GROUP BY barcode, pool HAVING COUNT(*) FILTER (dataset = 'click') > 0 AND COUNT(*) FILTER (dataset = 'view') > 0")
def j8(spark, d):
    q = view(spark, d, "v_qc").select(F.col("cell_type").alias("barcode"), (F.col("barcode") % 97).alias("pool"), "dataset", F.when(F.col("feature") > 50, "singlet").otherwise("doublet").alias("v"))
    return X.combine_tool_calls(q, ["barcode", "pool"], "dataset", "v", ["click", "view"], inner=True)


@query("w11_into_bins", """WITH e AS (SELECT dataset, quantile_cont(feature, 0) AS a, quantile_cont(feature, 0.25) AS b, quantile_cont(feature, 0.5) AS c, quantile_cont(feature, 0.75) AS d FROM v_qc GROUP BY dataset)
SELECT barcode, dataset, CASE WHEN feature <= b THEN 1 WHEN feature <= c THEN 2 WHEN feature <= d THEN 3 ELSE 4 END AS bin FROM v_qc JOIN e USING (dataset)""")
def w11(spark, d):
    return X.into_bins(view(spark, d, "v_qc"), "feature", ["dataset"], 4).select("barcode", "dataset", "bin")


@query("a26_metrics", """SELECT metric, MIN(x) AS low, MAX(x) AS high, ROUND(median(x), 6) AS median, ROUND(MIN(x) FILTER (cell_type > 0), 2) AS low_ok, ROUND(MAX(x) FILTER (cell_type > 0), 2) AS high_ok FROM (SELECT cell_type, unnest(['feature', 'barcode']) AS metric, unnest([feature, barcode::DOUBLE]) AS x FROM v_qc) y GROUP BY metric""")
def a26(spark, d):
    q = view(spark, d, "v_qc").withColumn("tag", F.when(F.col("cell_type") > 0, "NotOutlier").otherwise("Outlier"))
    return _round(X.qc_metrics_limits(q, ["feature", "barcode"], "tag"), "median")


@query("j1_with_pairing", """SELECT c.barcode, c.pool, c.sample, c.droplet, c.cell_type, n.ancestry, n.pool AS paired, c.sample || ';;' || c.pool AS assignment_run_lane FROM v_full c LEFT JOIN (SELECT * FROM v_donors WHERE sample % 2 = 0) n ON c.sample = n.sample WHERE c.droplet = 'singlet'""")
def j1(spark, d):
    f = view(spark, d, "v_full")
    donors = view(spark, d, "v_donors").where("sample % 2 = 0")
    m = M.build_cell_metadata(
        f.select("barcode", "pool", "sample", "dataset"), f.where("droplet = 'singlet'").select("barcode", "pool", "dataset", "droplet"), f.select("barcode", "cell_type"),
        donors.select("sample", "dataset", "ancestry"), donors.select("sample", F.col("pool").alias("paired")),
    )
    return M.assignment_key(m).drop("dataset")


@query("j11_overlap_sizes", """WITH s AS (SELECT sample, bool_or(k = 1) AS a, bool_or(k = 2) AS b, bool_or(k = 3) AS c FROM (SELECT sample, 1 AS k FROM v_donors UNION ALL SELECT sample, 2 FROM v_genotypes_all UNION ALL SELECT sample, 3 FROM v_expr WHERE gene % 3 = 0) x GROUP BY sample)
SELECT unnest(['gte', 'vcf', 'gte+vcf', 'expr', 'gte+expr', 'vcf+expr', 'gte+vcf+expr']) AS sets, unnest([COUNT(*) FILTER (a), COUNT(*) FILTER (b), COUNT(*) FILTER (a AND b), COUNT(*) FILTER (c), COUNT(*) FILTER (a AND c), COUNT(*) FILTER (b AND c), COUNT(*) FILTER (a AND b AND c)]) AS n FROM s""")
def j11(spark, d):
    return M.overlap_sizes({"gte": view(spark, d, "v_donors").select("sample"), "vcf": view(spark, d, "v_genotypes_all").select("sample").distinct(), "expr": view(spark, d, "v_expr").where("gene % 3 = 0").select("sample").distinct()})


@query("j16_by_method", """WITH c AS (SELECT barcode, 'b' AS method, tool_b AS call FROM v_calls UNION ALL SELECT barcode, 'a', CASE WHEN barcode % 3 = 0 THEN 'view' ELSE tool_a END FROM v_calls)
SELECT method, r.pool, COUNT(*) AS total, COUNT(*) FILTER (c.call <> 'view') AS assigned, COUNT(*) FILTER (c.call = r.tool_a) AS matched, ROUND(100.0 * COUNT(*) FILTER (c.call = r.tool_a) / COUNT(*), 6) AS pct_total,
ROUND(100.0 * COUNT(*) FILTER (c.call = r.tool_a) / NULLIF(COUNT(*) FILTER (c.call <> 'view'), 0), 6) AS pct_assigned FROM c JOIN v_calls r USING (barcode) GROUP BY GROUPING SETS ((method), (method, r.pool))""")
def j16(spark, d):
    c = view(spark, d, "v_calls")
    a = c.select("barcode", F.lit("a").alias("method"), F.when(F.col("barcode") % 3 == 0, "view").otherwise(F.col("tool_a")).alias("call"))
    calls = c.select("barcode", F.lit("b").alias("method"), F.col("tool_b").alias("call")).union(a)
    return _round(M.demux_match_by_method(c.select("barcode", "pool", F.col("tool_a").alias("call")), calls, "view"), "pct_total", "pct_assigned")


@query("a7_genes_grid", 'SELECT cell_type, CAST(COUNT(DISTINCT gene) AS BIGINT) AS "all", CAST(COUNT(DISTINCT gene) FILTER (cnt > 25) AS BIGINT) AS "high" FROM v_counts JOIN v_cells USING (barcode) GROUP BY cell_type')
def a7(spark, d):
    j = view(spark, d, "v_counts").join(view(spark, d, "v_cells").select("barcode", "cell_type"), "barcode")
    n = lambda df, name: df.groupBy("cell_type").agg(F.count_distinct("gene").alias("n_genes")).withColumn("filter", F.lit(name))
    return M.genes_grid(n(j, "all").union(n(j.where("cnt > 25"), "high")), ["cell_type"], ["all", "high"])


@query("a16_overview_full", """SELECT flag, COUNT(DISTINCT gene % 7) AS n_groups, COUNT(DISTINCT gene) AS n_genes, CAST(SUM(n) AS BIGINT) AS n_tested, COUNT(*) FILTER (length(alleles) = 3) AS n_snps, ROUND(AVG(n), 1) AS mean_n, COUNT(*) FILTER (p < 0.05) AS n_p, NULL::BIGINT AS n_text,
COUNT(*) FILTER (abs(z) >= 3) AS z_x, COUNT(*) FILTER (abs(beta) >= 0.03) AS z_y FROM v_study GROUP BY flag""")
def a16(spark, d):
    e = view(spark, d, "v_study").select("flag", "gene", (F.col("gene") % 7).alias("group"), F.col("n").alias("n_tested"), "alleles", "n", "p", F.lit("-").alias("text"), F.create_map(F.lit("x"), F.col("z"), F.lit("y"), F.col("beta") * 100).alias("zs"))
    out = M.qtl_overview_full(e, ["flag"], ["p", "text"], 0.05, 3)
    return out.select("*", F.element_at("n_z", "x").alias("z_x"), F.element_at("n_z", "y").alias("z_y")).drop("n_z")


@query("a17_pipeline_overview", """WITH s AS (SELECT cell_type, dataset, sample, COUNT(*) AS n_cells FROM v_full GROUP BY 1, 2, 3), g AS (SELECT cell_type, COUNT(DISTINCT gene) AS genes_input, COUNT(DISTINCT gene) FILTER (cnt > 25) AS genes_expressed FROM v_counts JOIN v_full USING (barcode) GROUP BY cell_type)
SELECT cell_type, dataset, n_samples, n_cells, n_outliers, cells_removed, n_kept, cells_kept, genes_input, genes_expressed FROM (SELECT cell_type, dataset, COUNT(*) AS n_samples, CAST(SUM(n_cells) AS BIGINT) AS n_cells, COUNT(*) FILTER (sample % 5 = 0) AS n_outliers, CAST(COALESCE(SUM(n_cells) FILTER (sample % 5 = 0), 0) AS BIGINT) AS cells_removed,
COUNT(*) FILTER (sample % 5 > 0) AS n_kept, CAST(COALESCE(SUM(n_cells) FILTER (sample % 5 > 0), 0) AS BIGINT) AS cells_kept FROM s GROUP BY GROUPING SETS ((cell_type), (cell_type, dataset))) x LEFT JOIN g USING (cell_type)""")
def a17(spark, d):
    stats = view(spark, d, "v_full").groupBy("cell_type", "dataset", "sample").agg(F.count("*").alias("n_cells"))
    j = view(spark, d, "v_counts").join(view(spark, d, "v_full").select("barcode", "cell_type"), "barcode")
    n = lambda df, name: df.groupBy("cell_type").agg(F.count_distinct("gene").alias("n_genes")).withColumn("filter", F.lit(name))
    links = stats.select("cell_type", "sample", (F.col("sample") % 5 > 0).alias("include"))
    return M.pipeline_overview(stats, n(j, "Input").union(n(j.where("cnt > 25"), "CPMFilter")), links, {"Input": "genes_input", "CPMFilter": "genes_expressed"})


@query("a23_kept_share", """SELECT chr, CAST(SUM(rejected) AS BIGINT) AS rejected, CAST(SUM(kept) AS BIGINT) AS kept, ROUND(100.0 * SUM(kept) / SUM(kept + rejected), 6) AS pct_kept FROM (SELECT 1 + snp % 22 AS chr, CASE WHEN p < 0.5 THEN 1 ELSE 0 END AS rejected, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS kept FROM v_effects) x GROUP BY ROLLUP (chr)""")
def a23(spark, d):
    e = view(spark, d, "v_effects").select((1 + F.col("snp") % 22).alias("chr"), (F.col("p") < 0.5).alias("_r"))
    kept = e.groupBy("chr").agg(F.count_if("_r").alias("rejected"), F.count_if(~F.col("_r")).alias("kept"))
    tally = M.filter_log_tally(e.where("_r").select("chr", F.lit("other").alias("reason"), F.lit("").alias("values")), 0, 0, 0)
    return _round(M.kept_share(tally, kept), "pct_kept").drop("n_reasons")


@query("a25_differing_entries", """SELECT barcode, gene, COALESCE(x.cnt, 0) AS x, COALESCE(y.cnt, 0) AS y FROM (SELECT * FROM v_counts WHERE barcode IN (SELECT barcode FROM v_counts_open) AND gene IN (SELECT gene FROM v_counts_open)) x FULL JOIN v_counts_open y USING (barcode, gene) WHERE COALESCE(x.cnt, 0) <> COALESCE(y.cnt, 0)""")
def a25(spark, d):
    return M.differing_entries(view(spark, d, "v_counts"), view(spark, d, "v_counts_open"))


@query("w7_grouped_batches", """WITH RECURSIVE g AS (SELECT grp, k, ROW_NUMBER() OVER (ORDER BY chr, start, grp) AS r FROM (SELECT gene * 7 % 997 AS grp, COUNT(*) AS k, arg_min(chr, (chr, chr_start, gene)) AS chr, arg_min(chr_start, (chr, chr_start, gene)) AS start FROM v_genes GROUP BY 1) x),
s AS (SELECT grp, r, 0 AS b, k AS fill FROM g WHERE r = 1 UNION ALL SELECT g.grp, g.r, CASE WHEN fill >= 10 OR fill + k > 12 THEN b + 1 ELSE b END, CASE WHEN fill >= 10 OR fill + k > 12 THEN k ELSE fill + k END FROM s JOIN g ON g.r = s.r + 1)
SELECT grp AS "group", CAST(b AS BIGINT) AS batch FROM s""")
def w7(spark, d):
    """Groups whose genes lie on many chromosomes; batches go on from one chromosome to the next."""
    return M.grouped_batches(view(spark, d, "v_genes").withColumn("group", F.col("gene") * 7 % 997), 10, 2)


@query("u3_join_corrected", "SELECT gene, sample, value FROM v_tall WHERE gene IN (SELECT gene FROM v_tall GROUP BY gene HAVING COUNT(*) FILTER (sample < 4) > 0 AND COUNT(*) FILTER (sample >= 4) > 0)")
def u3(spark, d):
    e = view(spark, d, "v_tall")
    return M.join_corrected([e.where("sample < 4"), e.where("sample >= 4")])


@query("u4_dense", """SELECT snp, sample, dosage, CASE WHEN dosage IS NULL THEN './.' WHEN dosage = 0 THEN '0/0' WHEN dosage = 1 THEN '0/1' ELSE '1/1' END AS gt FROM (SELECT DISTINCT snp FROM v_genotypes_all) v CROSS JOIN (SELECT DISTINCT CAST(sample AS VARCHAR) AS sample FROM v_genotypes_all) s
LEFT JOIN (SELECT snp, CAST(sample AS VARCHAR) AS sample, dosage FROM v_genotypes_all) g USING (snp, sample)""")
def u4(spark, d):
    g = view(spark, d, "v_genotypes_all")
    return M.densify_genotypes(M.merge_genotypes({"x": g.where("sample % 2 = 0"), "y": g.where("sample % 2 = 1")}))


@query("u2_with_links", "SELECT DISTINCT CAST(sample AS VARCHAR) AS genotype_id, CAST(sample AS VARCHAR) AS expression_id, CASE WHEN sample < 6 THEN 'x' ELSE 'y' END AS dataset FROM v_tall")
def u2(spark, d):
    """The links that go with expression matrices side by side."""
    e = view(spark, d, "v_tall").select(F.col("sample").cast("string").alias("sample"), F.when(F.col("sample") < 6, "x").otherwise("y").alias("dataset")).distinct()
    return M.combine_datasets({n: C.gte_links(e.where(F.col("dataset") == n)).drop("dataset") for n in ("x", "y")})


@query("j5_find_snps", "SELECT '1' AS one, w.position, v.snp, v.alleles FROM (SELECT DISTINCT 'chr' || chr || ':' || pos AS position, chr, pos FROM v_variants UNION SELECT 'chr1:-5', 1, -5) w LEFT JOIN v_variants v ON v.chr = w.chr AND v.pos = w.pos")
def j5(spark, d):
    v = view(spark, d, "v_variants")
    wanted = v.select(F.concat(F.lit("chr"), F.col("chr"), F.lit(":"), F.col("pos")).alias("position")).distinct().union(spark.sql("SELECT 'chr1:-5'"))
    return G.find_snps(wanted, v).select(F.lit("1").alias("one"), "position", "snp", "alleles")


@query("j6_wanted_pairs", """SELECT gene, snp, flag, k AS n_tests, symbol, pos AS snp_position FROM (SELECT *, COUNT(*) OVER (PARTITION BY gene) AS k FROM v_effects) e LEFT JOIN (SELECT gene, symbol FROM v_genes) g USING (gene) JOIN (SELECT snp, pos FROM v_variants WHERE snp % 2 = 0) v USING (snp) WHERE (gene, snp) IN (SELECT (gene, snp) FROM v_effects WHERE p < 0.2)""")
def j6(spark, d):
    e = view(spark, d, "v_effects")
    return G.assemble_qtl_chunks(e.select("gene", "snp", "flag"), view(spark, d, "v_genes").select("gene", "symbol"), view(spark, d, "v_variants").where("snp % 2 = 0").select("snp", "pos"), e.where("p < 0.2"), {"pos": "snp_position"})


@query("j10_by_variant", "SELECT snp, COUNT(*) AS compared, COUNT(*) FILTER (dosage <> CASE WHEN sample % 5 = 0 THEN 0 ELSE dosage END) AS discordant FROM v_genotypes_all WHERE dosage IS NOT NULL GROUP BY snp")
def j10(spark, d):
    g = view(spark, d, "v_genotypes_all")
    return G.discordant_variants(g, g.withColumn("dosage", F.when((F.col("sample") % 5 == 0) & F.col("dosage").isNotNull(), 0).otherwise(F.col("dosage"))))


@query("j10_by_field", """SELECT field, COUNT(*) AS n, bool_and(x = y) AS all_equal, ROUND(corr(TRY_CAST(x AS DOUBLE), TRY_CAST(y AS DOUBLE)), 6) AS r FROM (SELECT unnest(['pos', 'chr', 'alleles']) AS field, unnest([CAST(pos AS VARCHAR), CAST(chr AS VARCHAR), alleles]) AS x, unnest([CAST(pos * snp % 1000 AS VARCHAR), CAST(chr AS VARCHAR), alleles]) AS y FROM v_variants) q GROUP BY field""")
def j10_fields(spark, d):
    """Variants of two tables that name their alleles in another order."""
    v = G.match_variants(view(spark, d, "v_variants"))
    other = view(spark, d, "v_variants").withColumn("alleles", F.array_join(F.reverse(F.split("alleles", "/")), "/"))
    other = G.match_variants(other).withColumns({"pos": F.col("pos") * F.col("snp") % 1000, "alleles": F.array_join(F.reverse(F.split("alleles", "/")), "/")})
    return _round(G.field_concordance(v, other, "variant", ["pos", "chr", "alleles"]), "r")


@query("j12_from_positions", "SELECT gene, snp, chr, pos, pos - chr_start AS distance FROM (SELECT gene, snp, chr, pos FROM v_effects JOIN v_variants USING (snp) WHERE flag = 'A') t JOIN (SELECT gene, chr, chr_start FROM v_genes) g USING (gene, chr)")
def j12(spark, d):
    g = view(spark, d, "v_genes").select("gene", F.col("chr").alias("gene_chr"), F.col("chr_start").alias("gene_pos"))
    top = view(spark, d, "v_effects").where("flag = 'A'").select("gene", "snp").join(view(spark, d, "v_variants").select("snp", "chr", "pos"), "snp").join(g, "gene")
    return G.tss_distance(top).select("gene", "snp", "chr", "pos", "distance")


@query("j18_masked", "SELECT gene, snp, p, CASE WHEN snp % 3 > 0 THEN string_split(alleles, '/')[1] END AS oa, CASE WHEN snp % 3 > 0 THEN 7 * snp END AS score FROM (SELECT gene, snp, p FROM v_effects WHERE flag = 'A') e LEFT JOIN (SELECT snp, alleles FROM v_variants) v USING (snp)")
def j18(spark, d):
    v = view(spark, d, "v_variants").where("snp % 3 > 0")
    stats = v.select("snp", (7 * F.col("snp")).alias("score"), F.lit(1).alias("mask")).union(v.select("snp", F.lit(-1), F.lit(0)))
    return G.attach_variant_info(view(spark, d, "v_effects").where("flag = 'A'").select("gene", "snp", "p"), v.select("snp", "alleles"), stats).select("gene", "snp", "p", "oa", "score")


@query("f13_head_tail", "SELECT gene, sample, value FROM v_tall WHERE gene IN (SELECT DISTINCT gene FROM v_tall ORDER BY gene LIMIT 30) AND gene IN (SELECT gene FROM (SELECT DISTINCT gene FROM v_tall ORDER BY gene LIMIT 30) x ORDER BY gene DESC LIMIT 10)")
def f13(spark, d):
    return G.filter_matrix(view(spark, d, "v_tall"), head=30, tail=10)
