"""Queries of variants, genotypes, annotation and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genetics as G
from .registry import query
from .views import view


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _flag(spark, d, flag):
    return view(spark, d, "v_effects", flag).drop("flag")


@query("f4_standardize", """SELECT 'G' || gene AS gene, CAST(snp AS VARCHAR) AS snp, CASE ea WHEN 'A' THEN 'T' END AS ea, p * 2 AS p, 'G' || gene || '_' || snp AS key FROM v_effects WHERE p * 2 <= 1""")
def f4(spark, d):
    raw = view(spark, d, "v_effects").select(F.concat(F.lit("ENS_G"), F.col("gene"), F.lit(".3")).alias("name"), F.concat(F.lit("1:"), F.col("snp")).alias("variant"), "ea", (F.col("p") * 2).alias("p"))
    specs = {"gene": [("name", r"ENS_(G\d+)\.", "")], "snp": [("variant", r"\d+:(\d+)", ""), ("absent", None, "x")], "ea": [("ea", {"A": "T"}, "")], "p": [("p", None, "")]}
    return G.standardize(raw, specs, ["p"], ["p"])


@query("f5_translate_genes", "SELECT flag, gene, snp, symbol FROM v_effects LEFT JOIN (SELECT gene, MIN(symbol) AS symbol FROM v_genes WHERE gene % 2 = 0 GROUP BY gene) g USING (gene)")
def f5(spark, d):
    return G.translate_genes(view(spark, d, "v_effects"), view(spark, d, "v_genes").where("gene % 2 = 0"), "gene", "symbol").select("flag", "gene", "snp", "symbol")


@query("f6_fill_missing_stats", """SELECT flag, gene, snp, CASE WHEN ea = 'A' THEN 'G' ELSE 'A' END AS oa, ROUND(LEAST(p, 1 - p), 6) AS maf, CAST(floor(n / LEAST(p, 1 - p) / 2) AS BIGINT) AS n, ROUND(LEAST(1.0, p * 5), 6) AS bonferroni FROM v_effects WHERE p < 1""")
def f6(spark, d):
    e = view(spark, d, "v_effects").where("p < 1").select("flag", "gene", "snp", "ea", F.lit("A/G").alias("alleles"), F.col("p").alias("af"), F.col("n").alias("mac"), "p", F.lit(5).alias("n_tests"))
    return _round(G.fill_missing_stats(e, infer=False), "maf", "bonferroni").select("flag", "gene", "snp", "oa", "maf", "n", "bonferroni")


_STATS = "SELECT snp, COUNT(*) AS n, COUNT(dosage) AS called, SUM(dosage) / 2 / COUNT(dosage) AS af, COUNT(*) FILTER (dosage = 0) AS n0, COUNT(*) FILTER (dosage = 1) AS n1, COUNT(*) FILTER (dosage = 2) AS n2 FROM v_genotypes GROUP BY snp"


@query("a22_variant_stats", f"SELECT snp, n, n0, n1, n2, ROUND(CAST(called AS DOUBLE) / n, 6) AS call, ROUND(LEAST(af, 1 - af), 6) AS maf FROM ({_STATS}) x", whole=("v_genotypes", "v_genotypes_all"))
def a22(spark, d, genotypes="v_genotypes"):
    return _round(G.variant_stats(view(spark, d, genotypes)), "call", "maf")


@query("f12_filter_variants", f"SELECT snp FROM ({_STATS}) x WHERE CAST(called AS DOUBLE) / n >= 0.9 AND LEAST(af, 1 - af) >= 0.45 AND snp IN (SELECT snp FROM v_variants WHERE chr < 12)", whole=("v_genotypes", "v_genotypes_all"))
def f12(spark, d, genotypes="v_genotypes"):
    return G.filter_variants(G.variant_stats(view(spark, d, genotypes)), {"call": 0.9, "maf": 0.45}, view(spark, d, "v_variants").where("chr < 12")).select("snp")


@query("f13_filter_matrix", "SELECT gene, sample, value FROM v_expr WHERE gene IN (SELECT gene FROM v_genes WHERE chr = 3) AND sample IN (SELECT sample FROM v_donors WHERE dataset = 'BUILDING')")
def f13(spark, d):
    return G.filter_matrix(view(spark, d, "v_expr"), view(spark, d, "v_genes").where("chr = 3"), view(spark, d, "v_donors").where("dataset = 'BUILDING'"))


@query("j5_add_snp_positions", "SELECT flag, gene, snp, chr, pos, alleles FROM v_effects LEFT JOIN (SELECT * FROM v_variants WHERE snp % 3 > 0) v USING (snp)")
def j5(spark, d):
    return G.add_snp_positions(view(spark, d, "v_effects"), view(spark, d, "v_variants").where("snp % 3 > 0")).select("flag", "gene", "snp", "chr", "pos", "alleles")


@query("j6_assemble_qtl_chunks", """SELECT gene, snp, flag, COUNT(*) OVER (PARTITION BY gene) AS n_tests, symbol, pos FROM v_effects LEFT JOIN (SELECT gene, symbol FROM v_genes) g USING (gene) LEFT JOIN (SELECT snp, pos FROM v_variants) v USING (snp)""")
def j6(spark, d):
    return G.assemble_qtl_chunks(view(spark, d, "v_effects").select("gene", "snp", "flag"), view(spark, d, "v_genes").select("gene", "symbol"), view(spark, d, "v_variants").select("snp", "pos"))


@query("j10_genotype_concordance", "SELECT sample, COUNT(*) AS compared, COUNT(*) FILTER (dosage = CASE WHEN snp % 5 = 0 THEN 0 ELSE dosage END) AS equal FROM v_genotypes WHERE dosage IS NOT NULL GROUP BY sample", whole=("v_genotypes", "v_genotypes_all"))
def j10(spark, d, genotypes="v_genotypes"):
    g = view(spark, d, genotypes)
    return G.genotype_concordance(g, g.withColumn("dosage", F.when((F.col("snp") % 5 == 0) & F.col("dosage").isNotNull(), 0).otherwise(F.col("dosage"))))


@query("j12_tss_distance", """SELECT gene, chr, snp, pos, CASE strand WHEN '-' THEN chr_end ELSE chr_start END AS tss, CASE strand WHEN '-' THEN chr_end - pos ELSE pos - chr_start END AS distance
FROM (SELECT gene, snp, chr, pos FROM v_effects JOIN v_variants USING (snp) WHERE flag = 'A') t JOIN v_genes USING (gene, chr)""")
def j12(spark, d):
    top = _flag(spark, d, "A").select("gene", "snp").join(view(spark, d, "v_variants").select("snp", "chr", "pos"), "snp")
    return G.tss_distance(top, view(spark, d, "v_genes")).select("gene", "chr", "snp", "pos", "tss", "distance")


@query("j13_natural_match", "SELECT a.gene, a.snp, a.p AS p_top, r.n FROM v_effects a JOIN v_effects r ON a.gene = r.gene AND a.snp = r.snp AND ROUND(a.beta, 6) = ROUND(r.beta, 6) WHERE a.flag = 'A' AND r.flag = 'R'")
def j13(spark, d):
    a = _flag(spark, d, "A").select("gene", "snp", F.col("p").alias("p_top"), "beta")
    return G.natural_match(a, _flag(spark, d, "R").select("gene", "snp", "n", "beta"), {"beta": 6}).drop("beta")


_TOP = "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY flag, gene ORDER BY p, snp) AS r FROM v_effects) t WHERE r = 1)"


def _top(spark, d, flag):
    return _flag(spark, d, flag).groupBy("gene").agg(F.min_by(F.struct("snp", "ea", "beta"), F.struct("p", "snp")).alias("t")).select("gene", "t.*")


@query("j17_compare_engines", f"SELECT a.gene, a.snp, a.ea, a.beta, CASE WHEN a.ea <> b.ea THEN -b.beta ELSE b.beta END AS beta_b FROM {_TOP} a JOIN {_TOP} b ON a.gene = b.gene WHERE a.flag = 'A' AND b.flag = 'R'")
def j17(spark, d):
    return G.compare_engines(_top(spark, d, "A"), _top(spark, d, "R"))


@query("j18_attach_variant_info", f"SELECT gene, snp, p, string_split(alleles, '/')[1] AS oa, string_split(alleles, '/')[2] AS ea, n0 FROM (SELECT gene, snp, p FROM v_effects WHERE flag = 'A') e LEFT JOIN (SELECT snp, alleles FROM v_variants) v USING (snp) LEFT JOIN ({_STATS}) s USING (snp)", whole=("v_genotypes", "v_genotypes_all"))
def j18(spark, d, genotypes="v_genotypes"):
    stats = G.variant_stats(view(spark, d, genotypes)).select("snp", "n0")
    return G.attach_variant_info(_flag(spark, d, "A").select("gene", "snp", "p"), view(spark, d, "v_variants").select("snp", "alleles"), stats)


@query("h20_meta_analyse", "SELECT gene, snp, COUNT(*) AS n_datasets, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(sqrt(n) * (beta + 0.06::DOUBLE) * 100) / sqrt(SUM(n)), 6) AS z FROM v_effects GROUP BY gene, snp HAVING COUNT(*) >= 2")
def h20(spark, d):
    return _round(G.meta_analyse(view(spark, d, "v_effects").withColumn("z", (F.col("beta") + 0.06) * 100)), "z")


@query("w6_merge_top_effects", f"SELECT gene, snp, ea, beta FROM {_TOP} x WHERE flag = 'A'")
def w6(spark, d):
    t = _top(spark, d, "A")
    return G.merge_top_effects(t.where("gene % 3 < 2").unionByName(t.where("gene % 3 > 0")))


_RB = """SELECT a, b, u, v FROM (SELECT x.beta AS a, x.beta * 0.7 + y.beta AS b, x.beta_se / 10 AS u, y.beta_se / 10 AS v FROM v_study x JOIN v_study y ON x.gene = y.gene AND x.snp = y.snp WHERE x.flag = 'A' AND y.flag = 'R') q"""


@query("h3_rb", f"""SELECT n, ROUND(r, 6) AS rb FROM (SELECT COUNT(*) AS n, covar_samp(a, b) / sqrt((var_samp(a) - AVG(u * u)) * (var_samp(b) - AVG(v * v))) AS r FROM ({_RB}) z) y""")
def h3(spark, d):
    return _round(G.rb(_rb(spark, d)), "rb").select("n", "rb")


def _rb(spark, d):
    s = lambda flag: view(spark, d, "v_study").where(F.col("flag") == flag)
    x = s("A").select("gene", "snp", F.col("beta").alias("b1"), (F.col("beta_se") / 10).alias("se1"))
    y = s("R").select("gene", "snp", F.col("beta").alias("_y"), (F.col("beta_se") / 10).alias("se2"))
    return x.join(y, ["gene", "snp"]).select("b1", "se1", (F.col("b1") * 0.7 + F.col("_y")).alias("b2"), "se2")
