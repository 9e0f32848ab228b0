"""Queries of tests, rates, replication, matrices and association."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import scalars as S
from ..operators import effects as E
from ..operators import expression as X
from ..operators import genetics as G
from ..operators import matrix as M
from ..operators import ranking as R
from ..operators.order import average_ranks
from ..sources.effects import source_specs
from .association import _RB, _rb
from .registry import query
from .views import view


def _round(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


def _study(spark, d, flag=None):
    return view(spark, d, "v_study", flag).drop("flag") if flag else view(spark, d, "v_study")


def _two_sided(z: str) -> str:
    """2 Phi(-|z|) by the series of the error function."""
    terms = f"list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
    return f"CASE WHEN {z} = 0 THEN 1 WHEN abs({z}) > 8 THEN 0 ELSE greatest(0, 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms}) END"


def _t_p(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite series of Student's distribution in sine and cosine."""
    s, c2 = f"abs({r})", f"(1 - ({r}) * ({r}))"  # sine and squared cosine of atan(t / sqrt(n - 2))
    even = f"{s} * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln({c2}))))"
    odd = f"2 / pi() * (asin({s}) + {s} * COALESCE(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(ln(pi()) / 2 + lgamma(k + 1) - ln(2) - lgamma(k + 1.5) + (k + 0.5) * ln({c2})))), 0))"
    return f"CASE WHEN {n} < 2 OR {r} IS NULL THEN NULL WHEN {n} = 2 OR {c2} >= 1 THEN 1 WHEN {c2} <= 1e-15 THEN 0 WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


_PI0 = " + ".join(f"{w!r}::DOUBLE * COUNT(*) FILTER (p >= {x!r}::DOUBLE) / COUNT(*) / {1 - x!r}::DOUBLE" for x, w in zip(R.LAMBDAS, map(float, R.smoother_weights()), strict=True))
_BH = "LEAST(1.0, MIN(p * m / r) OVER (PARTITION BY flag ORDER BY r DESC ROWS UNBOUNDED PRECEDING))"
_RANKED = "SELECT *, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY p) AS r, COUNT(*) OVER (PARTITION BY flag) AS m FROM v_effects"


@query("h1_qvalues", f"SELECT flag, gene, snp, ROUND(LEAST(1.0, pi0) * {_BH}, 6) AS q FROM ({_RANKED}) x JOIN (SELECT flag, {_PI0} AS pi0 FROM v_effects GROUP BY flag) y USING (flag)")
def h1(spark, d):
    return _round(R.qvalues(view(spark, d, "v_effects"), "p", ["flag"]).select("flag", "gene", "snp", "q"), "q")


@query("h2_pi1", f"SELECT flag, COUNT(*) AS m, ROUND(1 - LEAST(1.0, {_PI0}), 6) AS pi1 FROM (SELECT flag, p * p / MAX(p * p) OVER (PARTITION BY flag) AS p FROM v_effects) x GROUP BY flag")
def h2(spark, d):
    return _round(R.pi1(view(spark, d, "v_effects").withColumn("p", F.col("p") * F.col("p")), "p", ["flag"]), "pi1")


@query("h3_rb_jackknife", f"""WITH q AS ({_RB}), s AS (SELECT COUNT(*) AS n, SUM(a) AS sa, SUM(b) AS sb, SUM(a * a) AS saa, SUM(b * b) AS sbb, SUM(a * b) AS sab, SUM(u * u) AS su, SUM(v * v) AS sv FROM q),
l AS (SELECT ((sab - a * b) - (sa - a) * (sb - b) / (n - 1)) / (n - 2) AS c, ((saa - a * a) - (sa - a) * (sa - a) / (n - 1)) / (n - 2) AS va, ((sbb - b * b) - (sb - b) * (sb - b) / (n - 1)) / (n - 2) AS vb, (su - u * u) / (n - 1) AS mu, (sv - v * v) / (n - 1) AS mv FROM q, s),
j AS (SELECT sqrt((COUNT(*) - 1) * var_pop(greatest(-1, least(1, c / sqrt((va - mu) * (vb - mv)))))) AS se FROM l), t AS (SELECT COUNT(*) AS n, covar_samp(a, b) / sqrt((var_samp(a) - AVG(u * u)) * (var_samp(b) - AVG(v * v))) AS rb FROM q)
SELECT n, ROUND(rb, 6) AS rb, ROUND(se, 6) AS se, ROUND({_two_sided('rb / se')}, 6) AS p FROM t, j""")
def h3(spark, d):
    return _round(G.rb(_rb(spark, d)), "rb", "se", "p")


@query("h4_pearson_test", f"SELECT gene, n, ROUND(r, 6) AS r, ROUND({_t_p('r', 'n')}, 6) AS p FROM (SELECT gene, COUNT(*) AS n, CASE WHEN COUNT(*) > 1 AND var_pop(value) > 0 THEN corr(value::DOUBLE, (value * value % 17)::DOUBLE) END AS r FROM v_tall GROUP BY gene) x WHERE r IS NOT NULL AND NOT isnan(r)")
def h4(spark, d):
    e = view(spark, d, "v_tall").withColumn("other", F.col("value") * F.col("value") % 17)
    return _round(E.correlations(e, "value", "other", ["gene"]).where("r IS NOT NULL"), "r", "p")


@query("h4_spearman_test", f"""SELECT sample, n, ROUND(r, 6) AS r, ROUND({_t_p('r', 'n')}, 6) AS p FROM (SELECT sample, COUNT(*) AS n, corr(x, y) AS r FROM (SELECT sample,
RANK() OVER (PARTITION BY sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2.0::DOUBLE AS x, RANK() OVER (PARTITION BY sample ORDER BY value * value % 17) + (COUNT(*) OVER (PARTITION BY sample, value * value % 17) - 1) / 2.0::DOUBLE AS y
FROM v_tall) q GROUP BY sample) z""")
def h4s(spark, d):
    e = view(spark, d, "v_tall").withColumn("other", F.col("value") * F.col("value") % 17)
    x = average_ranks(e, "value", ["sample"]).withColumnRenamed("rank", "x")
    return _round(E.correlations(average_ranks(x, "other", ["sample"]).withColumnRenamed("rank", "y"), "x", "y", ["sample"]), "r", "p")


@query("h5_multiple_testing", f"""WITH a AS (SELECT flag, gene, snp, p, LEAST(1.0, p * (n % 4 + 1)) AS bonferroni, 1 + n % 3 AS a FROM v_effects),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY bonferroni) AS r, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY p) AS k, COUNT(*) OVER (PARTITION BY flag) AS m FROM a),
c AS (SELECT *, LEAST(1.0, MIN(bonferroni * m / r) OVER (PARTITION BY flag ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS bonferroni_bh, LEAST(1.0, MIN(p * m / k) OVER (PARTITION BY flag ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS bh FROM b),
e AS (SELECT c.*, bh * LEAST(1.0, pi0) AS q FROM c JOIN (SELECT flag, {_PI0} AS pi0 FROM v_effects GROUP BY flag) y USING (flag)),
t AS (SELECT flag, (MAX(CASE WHEN q <= 0.95 THEN p END) + MIN(CASE WHEN q > 0.95 THEN p END)) / 2 AS p_threshold FROM e GROUP BY flag)
SELECT flag, gene, snp, ROUND(bonferroni, 6) AS bonferroni, ROUND(bonferroni_bh, 6) AS bonferroni_bh, ROUND(bh, 6) AS bh, ROUND(q, 6) AS q, ROUND(p_threshold, 6) AS p_threshold, ROUND(power(p_threshold, 1.0 / a), 5) AS nominal_threshold FROM e JOIN t USING (flag)""")
def h5(spark, d):
    e = view(spark, d, "v_effects").select("flag", "gene", "snp", "p", (F.col("n") % 4 + 1).alias("n_tests"), (1 + F.col("n") % 3).cast("double").alias("a"), F.lit(1.0).alias("b"))
    out = E.multiple_testing(e, "p", 0.95, ["flag"], n_tests="n_tests", beta=("a", "b"))
    out = _round(out, "bonferroni", "bonferroni_bh", "bh", "q", "p_threshold").withColumn("nominal_threshold", F.round("nominal_threshold", 5))
    return out.drop("p", "n_tests", "a", "b")


@query("h6_pca", """WITH c AS (SELECT gene, sample, COALESCE(value, 0) AS x FROM (SELECT DISTINCT gene FROM v_tall) g CROSS JOIN (SELECT DISTINCT sample FROM v_tall) s LEFT JOIN v_tall USING (gene, sample)),
z AS (SELECT gene, sample, (x - AVG(x) OVER w) / stddev_samp(x) OVER w AS z, stddev_samp(x) OVER w AS s FROM c WINDOW w AS (PARTITION BY gene))
SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(SUM(a.z * b.z), 3) AS product FROM z a JOIN z b USING (gene) WHERE a.s > 0 AND b.s > 0 GROUP BY a.sample, b.sample""")
def h6(spark, d):
    """Products of the samples' scores over all components, which are those of their standardized values."""
    s = M.pca(view(spark, d, "v_tall"))["scores"]
    x = s.select("component", F.col("sample").alias("sample_a"), F.col("score").alias("a")).join(s.select("component", F.col("sample").alias("sample_b"), F.col("score").alias("b")), "component")
    return x.groupBy("sample_a", "sample_b").agg(F.round(F.sum(F.col("a") * F.col("b")), 3).alias("product"))


@query("h6_pca_rotation", """WITH c AS (SELECT gene, sample, COALESCE(value, 0) AS x FROM (SELECT DISTINCT gene FROM v_tall) g CROSS JOIN (SELECT DISTINCT sample FROM v_tall) s LEFT JOIN v_tall USING (gene, sample))
SELECT gene, sample, ROUND(z, 5) AS z FROM (SELECT gene, sample, (x - AVG(x) OVER w) / stddev_samp(x) OVER w AS z, stddev_samp(x) OVER w AS s FROM c WINDOW w AS (PARTITION BY gene)) y WHERE s > 0""")
def h6_rotation(spark, d):
    """Scores times the rotation are the standardized values."""
    p = M.pca(view(spark, d, "v_tall"))
    j = p["rotation"].join(p["scores"], "component")
    return j.groupBy("gene", "sample").agg(F.round(F.sum(F.col("weight") * F.col("score")), 5).alias("z"))


@query("h7_pca_outliers", """SELECT sample AS expression_id, dataset, ROUND(MAX(abs((value - m) / s)), 6) AS max_z, NOT COALESCE(MAX(abs((value - m) / s)) >= 1.5, FALSE) AS include FROM (SELECT gene, sample, value, AVG(value) OVER w AS m, NULLIF(stddev_samp(value) OVER w, 0) AS s
FROM v_tall WHERE gene <= 50 WINDOW w AS (PARTITION BY gene)) x JOIN (SELECT DISTINCT sample % 12 AS sample, MIN(dataset) AS dataset FROM v_donors GROUP BY 1) g USING (sample) GROUP BY sample, dataset""")
def h7(spark, d):
    gte = view(spark, d, "v_donors").groupBy((F.col("sample") % 12).alias("expression_id")).agg(F.min("dataset").alias("dataset"))
    return _round(M.pca_outliers(view(spark, d, "v_tall").withColumnsRenamed({"gene": "component", "value": "score"}), gte, 50, 1.5), "max_z")


@query("h8_design_matrix", """WITH n AS (SELECT dataset, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, dataset) AS r FROM v_donors GROUP BY dataset)
SELECT sample, 'intercept' AS "column", 1.0::DOUBLE AS value FROM v_donors UNION ALL SELECT sample, 'pool', CAST(pool AS DOUBLE) FROM v_donors
UNION ALL SELECT sample, 'dataset_' || n.dataset, CASE WHEN d.dataset = n.dataset THEN 1.0 ELSE 0.0 END FROM v_donors d, n WHERE r > 1""")
def h8(spark, d):
    v = view(spark, d, "v_donors")
    each = F.array(*(F.struct(F.lit(k).alias("covariate"), c.cast("string").alias("value")) for k, c in {"pool": F.col("pool"), "dataset": F.col("dataset"), "one": F.lit("x"), "zero": F.lit(0), "name": F.concat(F.lit("s"), F.col("sample"))}.items()))
    return M.design_matrix(v.select("sample", F.inline(each)))


@query("h9_regress_out", """SELECT gene, sample, ROUND(value - i - s * (sample * sample % 7), 5) + 0 AS value FROM v_tall JOIN (SELECT gene, regr_intercept(value, sample * sample % 7) AS i, regr_slope(value, sample * sample % 7) AS s FROM v_tall GROUP BY gene HAVING COUNT(DISTINCT sample * sample % 7) > 1) x USING (gene)
UNION ALL SELECT gene, sample, ROUND(value - m, 5) + 0 FROM v_tall JOIN (SELECT gene, AVG(value) AS m FROM v_tall GROUP BY gene HAVING COUNT(DISTINCT sample * sample % 7) = 1) x USING (gene)""")
def h9(spark, d):
    """An intercept, a numeric covariate, and a column that follows from both; genes lack samples in many patterns."""
    e, x = view(spark, d, "v_tall"), F.col("sample") * F.col("sample") % 7
    each = F.array(*(F.struct(F.lit(k).alias("column"), c.cast("double").alias("value")) for k, c in {"intercept": F.lit(1), "x": x, "y": 3 * x - 2}.items()))
    return _round(M.regress_out(e, e.select("sample").distinct().select("sample", F.inline(each))), "value", to=5).withColumn("value", F.col("value") + 0.0)


_TMM = """l AS (SELECT sample, SUM(value) AS size, COUNT(*) AS k FROM e GROUP BY sample), g AS (SELECT COUNT(DISTINCT gene) AS g FROM e), q AS (SELECT sample, size, (SELECT quantile_cont(x, 0.75) FROM (SELECT COALESCE(e.value, 0)::DOUBLE AS x FROM (SELECT DISTINCT gene FROM e) a LEFT JOIN e ON e.gene = a.gene AND e.sample = l.sample) y) / size AS q FROM l),
ref AS (SELECT sample, size FROM q, (SELECT AVG(q) AS m FROM q) a ORDER BY abs(q - m), sample LIMIT 1),
j AS (SELECT e.sample, log2((e.value / l.size) / (r.value / ref.size)) AS m, (log2(e.value / l.size) + log2(r.value / ref.size)) / 2 AS a, (l.size - e.value) / l.size / e.value + (ref.size - r.value) / ref.size / r.value AS v FROM e JOIN l USING (sample), ref, e r WHERE r.sample = ref.sample AND r.gene = e.gene),
k AS (SELECT *, COUNT(*) OVER (PARTITION BY sample) AS n, RANK() OVER (PARTITION BY sample ORDER BY m) + (COUNT(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS rm, RANK() OVER (PARTITION BY sample ORDER BY a) + (COUNT(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ra FROM j),
f AS (SELECT sample, CASE WHEN MAX(abs(m)) < 1e-6 THEN 0 ELSE SUM(m / v) FILTER (rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05)) / SUM(1 / v) FILTER (rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05)) END AS f FROM k GROUP BY sample),
t AS (SELECT sample, size, power(2, f - (SELECT AVG(f) FROM f)) AS factor FROM f JOIN l USING (sample))"""


@query("h10_tmm_factors", f"WITH e AS (SELECT gene, sample, value::DOUBLE AS value FROM v_tall), {_TMM} SELECT sample, size, ROUND(factor, 6) AS factor FROM t")
def h10(spark, d):
    return _round(M.tmm_factors(view(spark, d, "v_tall")), "factor")


@query("h10_tmm_cpm", f"WITH e AS (SELECT gene, sample, value::DOUBLE AS value FROM v_tall), {_TMM} SELECT gene, sample, ROUND(value / (size * factor) * 1000000, 4) AS cpm FROM e JOIN t USING (sample)")
def h10_cpm(spark, d):
    return _round(M.tmm_cpm(view(spark, d, "v_tall")), "cpm", to=4).select("gene", "sample", "cpm")


_KEPT = """o AS (SELECT gene, sample, value::DOUBLE AS value FROM v_tall), z AS (SELECT sample, SUM(value) AS size FROM o GROUP BY sample), c AS (SELECT 10 / median(size) * 1000000 AS cut, CASE WHEN COUNT(*) > 10 THEN 10 + (COUNT(*) - 10) * 0.7 ELSE COUNT(*) END AS enough FROM z),
w AS (SELECT gene FROM o JOIN z USING (sample), c GROUP BY gene, enough HAVING COUNT(*) FILTER (value / size * 1000000 >= cut) >= enough - 1e-14 AND SUM(value) >= 15), e AS (SELECT * FROM o WHERE gene IN (SELECT gene FROM w))"""
_LOG = f"WITH {_KEPT}, {_TMM}, x AS (SELECT a.gene, t.sample, log2((COALESCE(e.value, 0) + 0.5) / (size * factor + 1) * 1000000) AS x FROM (SELECT DISTINCT gene FROM e) a CROSS JOIN t LEFT JOIN e ON e.gene = a.gene AND e.sample = t.sample), p AS (SELECT gene, sample, x FROM x WHERE gene IN (SELECT gene FROM x GROUP BY gene HAVING AVG(x) > 9))"


@query("h12_log_cpm_filter", f"{_LOG} SELECT gene, sample, ROUND((RANK() OVER (PARTITION BY gene ORDER BY ROUND(x, 9)) + (COUNT(*) OVER (PARTITION BY gene, ROUND(x, 9)) - 1) / 2.0) / (COUNT(*) OVER (PARTITION BY gene) + 1), 6) AS u FROM p")
def h12(spark, d):
    z = M.log_cpm_filter(view(spark, d, "v_tall"), 9)[0]
    tail = D.two_sided_p(F.col("value")) / 2
    return z.select("gene", "sample", F.round(F.when(F.col("value") > 0, 1 - tail).otherwise(tail), 6).alias("u"))


@query("h12_steps", f"{_LOG} SELECT 'Input' AS filter, COUNT(DISTINCT gene) AS n_genes FROM o UNION ALL SELECT 'FilterByExp', COUNT(DISTINCT gene) FROM e UNION ALL SELECT 'CPMFilter', COUNT(DISTINCT gene) FROM p")
def h12_steps(spark, d):
    return M.log_cpm_filter(view(spark, d, "v_tall"), 9)[1]


@query("h11_filter_steps", """WITH g AS (SELECT gene, var_samp(value) <> 0 AS v, COUNT(*) FILTER (value > 0) > 2 AS o, AVG(value / s * 1000000) > 200 AS c FROM v_tall JOIN (SELECT sample, CAST(SUM(value) AS DOUBLE) AS s FROM v_tall GROUP BY sample) x USING (sample) GROUP BY gene)
SELECT unnest(['Input', 'Varfilter', 'MinObsFilter', 'CPMFilter']) AS filter, unnest([COUNT(*), COUNT(*) FILTER (v), COUNT(*) FILTER (v AND o), COUNT(*) FILTER (v AND o AND c)]) AS n_genes FROM g""")
def h11(spark, d):
    return X.filter_steps(view(spark, d, "v_tall"), 2, 200)


@query("h13_fit_chain", """WITH a AS (SELECT barcode, gene, ln(1 + cnt * AVG(d) OVER () / s) AS x FROM v_counts JOIN (SELECT barcode, CAST(SUM(cnt) AS DOUBLE) AS s FROM v_counts GROUP BY barcode) y USING (barcode), (SELECT AVG(s) AS d FROM (SELECT SUM(cnt) AS s FROM v_counts GROUP BY barcode) q) z),
b AS (SELECT barcode, SUM(x) AS s FROM a GROUP BY barcode) SELECT barcode, gene, ROUND(x * (SELECT AVG(s) FROM b) / s, 6) AS fit FROM a JOIN b USING (barcode)""")
def h13(spark, d):
    return _round(X.fit_chain(view(spark, d, "v_counts")), "fit")


_CORR = """WITH w AS (SELECT barcode, sample % 9 AS donor, 1 + barcode % 3 AS w FROM v_cells), x AS (SELECT donor, barcode, gene % 40 AS gene, SUM(cnt) AS x, MIN(w) AS w FROM v_counts JOIN w USING (barcode) GROUP BY donor, barcode, gene % 40),
k AS (SELECT donor, gene FROM x GROUP BY donor, gene HAVING COUNT(*) >= 5), t AS (SELECT donor, SUM(w) AS sw FROM w GROUP BY donor),
m AS (SELECT donor, gene, SUM(w * x) / sw AS mean, SUM(w * x * x) / sw - (SUM(w * x) / sw) * (SUM(w * x) / sw) AS var, sw FROM x JOIN k USING (donor, gene) JOIN t USING (donor) GROUP BY donor, gene, sw),
c AS (SELECT a.donor, a.gene AS gene_a, b.gene AS gene_b, SUM(a.w * a.x * b.x) AS xy FROM x a JOIN x b ON a.donor = b.donor AND a.barcode = b.barcode AND a.gene > b.gene GROUP BY 1, 2, 3),
r AS (SELECT a.donor, a.gene AS gene_a, b.gene AS gene_b, CASE WHEN a.var > 1e-14 AND b.var > 1e-14 THEN (COALESCE(xy, 0) / a.sw - a.mean * b.mean) / sqrt(a.var * b.var) END AS r FROM m a JOIN m b ON a.donor = b.donor AND a.gene > b.gene LEFT JOIN c ON c.donor = a.donor AND c.gene_a = a.gene AND c.gene_b = b.gene)"""


def _correlations(spark, d):
    cells = view(spark, d, "v_cells").select("barcode", (F.col("sample") % 9).alias("donor"), (1 + F.col("barcode") % 3).alias("weight"))
    counts = view(spark, d, "v_counts", deal=("l_orderkey",)).groupBy("barcode", (F.col("gene") % 40).alias("gene")).agg(F.sum("cnt").alias("cnt"))
    return M.weighted_gene_correlation(counts, cells, "donor", 5)


@query("h14_weighted_gene_correlation", f"{_CORR} SELECT donor, gene_a, gene_b, ROUND(r, 6) AS r FROM r")
def h14(spark, d):
    return _round(_correlations(spark, d), "r")


@query("h15_aggregate_correlations", f"{_CORR} SELECT gene_a, gene_b, " + ", ".join(f'ROUND(MAX(CASE WHEN donor = {i} THEN r END), 6) AS "{i}"' for i in range(9)) + " FROM r GROUP BY gene_a, gene_b")
def h15(spark, d):
    return _round(M.aggregate_correlations(_correlations(spark, d), "donor", list(range(9))), *(f"{i}" for i in range(9)))


_LINKS = "(SELECT sample % 12 AS sample, CASE WHEN sample % 12 < 6 THEN 'x' ELSE 'y' END AS dataset FROM v_donors GROUP BY 1, 2)"


@query("h16_by_dataset", f"""SELECT gene, dataset, COUNT(*) AS n, CASE WHEN stddev_samp(value) > 1e-7 AND stddev_samp(y) > 1e-7 THEN ROUND(corr(value::DOUBLE, y::DOUBLE), 6) + 0 END AS r FROM (SELECT gene, sample, value, value * value % 13 AS y FROM v_tall) a JOIN {_LINKS} l USING (sample) GROUP BY GROUPING SETS ((gene, dataset), (gene))""")
def h16(spark, d):
    a = view(spark, d, "v_tall")
    links = view(spark, d, "v_donors").select((F.col("sample") % 12).alias("expression_id")).distinct().withColumn("dataset", F.when(F.col("expression_id") < 6, "x").otherwise("y"))
    return _round(X.matched_correlation_by_dataset(a, a.withColumn("value", F.col("value") * F.col("value") % 13), links, center=True), "r").withColumn("r", F.col("r") + 0.0)


@query("h16_all_samples", "SELECT a.sample AS sample_a, b.sample AS sample_b, COUNT(*) AS n, ROUND(corr(a.value::DOUBLE, (b.value % 19)::DOUBLE), 6) + 0 AS r FROM v_tall a JOIN v_tall b USING (gene) GROUP BY a.sample, b.sample")
def h16_all_samples(spark, d):
    a = view(spark, d, "v_tall")
    return _round(X.all_sample_correlations(a, a.withColumn("value", F.col("value") % 19)), "r").withColumn("r", F.col("r") + 0.0)


@query("h17_masked", f"""SELECT column_a, column_b, n, ROUND(r, 6) AS r, ROUND(CASE WHEN {_t_p('r', 'n')} < 0.05 THEN r ELSE 0 END, 6) AS masked_r FROM (SELECT column_a, column_b, COUNT(*) AS n, corr(x, y) AS r FROM
(SELECT unnest(['n', 'p', 'p']) AS column_a, unnest(['beta', 'beta', 'n']) AS column_b, unnest([n::DOUBLE, p, p]) AS x, unnest([beta, beta, n::DOUBLE]) AS y FROM v_effects WHERE flag = 'A') q WHERE NOT (x = 0 AND y = 0) GROUP BY 1, 2) z""")
def h17(spark, d):
    e = view(spark, d, "v_effects").where("flag = 'A'").withColumn("key", F.concat_ws("_", "gene", "snp"))
    return _round(X.masked_correlations(e, e, "key", ["beta", "n", "p"], ["beta", "n", "p"], drop_paired_zero=True, triangle=True), "r", "masked_r").drop("p")


_TOP = "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY flag, gene ORDER BY p, snp) AS r FROM v_study) t WHERE r = 1)"
_PAIRS = f"""top AS (SELECT gene, snp, alleles, p, beta, beta_se, ea FROM {_TOP} x WHERE flag = 'A'), o AS (SELECT t.gene, t.p, t.beta, t.beta_se, r.p AS repl_p, r.beta_se AS repl_beta_se, CASE WHEN t.ea <> r.ea THEN -r.beta ELSE r.beta END AS repl_beta
FROM top t LEFT JOIN (SELECT * FROM v_study WHERE flag = 'R') r ON t.gene = r.gene AND t.snp = r.snp),
d AS (SELECT *, LEAST(1.0, MIN(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS k, COUNT(*) OVER () AS m FROM o) a),
s AS (SELECT *, LEAST(1.0, MIN(repl_p * m2 / k2) OVER (ORDER BY k2 DESC ROWS UNBOUNDED PRECEDING)) AS repl_fdr FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY repl_p) AS k2, COUNT(*) OVER () AS m2 FROM d WHERE fdr <= 0.6 AND repl_beta IS NOT NULL) b),
u AS (SELECT d.*, s.repl_fdr FROM d LEFT JOIN s USING (gene))"""


@query("h18_replication_pairs", f"WITH {_PAIRS} SELECT gene, ROUND(fdr, 6) AS fdr, ROUND(repl_fdr, 6) AS repl_fdr, ROUND(repl_beta, 6) + 0 AS repl_beta FROM u")
def h18_pairs(spark, d):
    return _round(E.replication_pipeline(_study(spark, d, "A"), _study(spark, d, "R"), 0.6)[0].select("gene", "fdr", "repl_fdr", "repl_beta"), "fdr", "repl_fdr", "repl_beta").withColumn("repl_beta", F.col("repl_beta") + 0.0)


_SCALED_PI0 = _PI0.replace("p >=", "repl_p / top_p >=")


@query("h18_replication", f"""WITH {_PAIRS}, v AS (SELECT *, unnest(CASE WHEN repl_fdr <= 0.6 THEN ['all', 'disc', 'both'] WHEN fdr <= 0.6 THEN ['all', 'disc'] ELSE ['all'] END) AS subset FROM u WHERE repl_beta IS NOT NULL),
b AS (SELECT subset, COUNT(*) AS n, CASE WHEN COUNT(*) > 1 THEN corr(beta, repl_beta) END AS r, 100.0 * AVG(CASE WHEN beta * repl_beta > 0 THEN 1.0 ELSE 0.0 END) AS ac FROM v GROUP BY subset),
h AS (SELECT 1 - LEAST(1.0, {_SCALED_PI0}) AS pi1, greatest(-1, least(1, covar_samp(beta, repl_beta) / sqrt(CASE WHEN var_samp(beta) > AVG(beta_se * beta_se) AND var_samp(repl_beta) > AVG(repl_beta_se * repl_beta_se)
THEN (var_samp(beta) - AVG(beta_se * beta_se)) * (var_samp(repl_beta) - AVG(repl_beta_se * repl_beta_se)) ELSE var_samp(beta) * var_samp(repl_beta) END))) AS rb FROM (SELECT *, MAX(repl_p) OVER () AS top_p FROM v WHERE subset = 'disc') q)
SELECT subset, n, ROUND(r, 6) AS r, ROUND({_t_p('r', 'n')}, 5) AS p, ROUND(ac, 6) AS ac, ROUND(CASE WHEN subset = 'disc' THEN pi1 END, 6) AS pi1, ROUND(CASE WHEN subset = 'disc' THEN rb END, 6) AS rb FROM b, h""")
def h18(spark, d):
    s = E.replication_pipeline(_study(spark, d, "A"), _study(spark, d, "R"), 0.6)[1]
    return _round(s, "r", "ac", "pi1", "rb").select("subset", "n", "r", F.round("p", 5).alias("p"), "ac", "pi1", "rb")


@query("a20_collect_replication_stats", """WITH o AS (SELECT a.flag AS disc, r.flag AS repl, a.p, r.p AS repl_p, a.beta, r.beta AS repl_beta FROM v_effects a JOIN v_effects r ON a.gene = r.gene AND a.snp = r.snp AND a.flag <> r.flag)
SELECT disc, repl, COUNT(*) FILTER (p <= 0.5) AS n_disc, COUNT(*) FILTER (p <= 0.5 AND repl_p <= 0.5) AS n_both, ROUND(100.0 * COUNT(*) FILTER (p <= 0.5 AND repl_p <= 0.5) / COUNT(*) FILTER (p <= 0.5), 6) AS pct_replicated,
ROUND(100.0 * AVG(CASE WHEN beta * repl_beta > 0 THEN 1.0 ELSE 0.0 END) FILTER (p <= 0.5), 6) AS ac FROM o GROUP BY disc, repl HAVING COUNT(*) FILTER (p <= 0.5) > 0""")
def a20(spark, d):
    return _round(E.collect_replication_stats(_run_stats(spark, d), ["disc"], ["repl"]), "pct_replicated", "ac").select("disc", "repl", "n_disc", "n_both", "pct_replicated", "ac")


def _run_stats(spark, d):
    e = view(spark, d, "v_effects").select("flag", "gene", "snp", "p", "beta")
    r = e.select(F.col("flag").alias("repl"), "gene", "snp", F.col("p").alias("repl_p"), F.col("beta").alias("repl_beta"))
    o = e.withColumnRenamed("flag", "disc").join(r, ["gene", "snp"]).where("disc <> repl")
    return E.replication_stats(o, 0.5, runs=("disc", "repl"))


@query("a20_matrix", """WITH o AS (SELECT a.flag AS disc, r.flag AS repl, a.p, r.p AS repl_p FROM v_effects a JOIN v_effects r ON a.gene = r.gene AND a.snp = r.snp AND a.flag <> r.flag)
SELECT disc, """ + ", ".join(f"ROUND(100.0 * COUNT(*) FILTER (repl = '{x}' AND p <= 0.5 AND repl_p <= 0.5) / NULLIF(COUNT(*) FILTER (repl = '{x}' AND p <= 0.5), 0), 6) AS \"{x}\"" for x in "ANR") + " FROM o GROUP BY disc")
def a20_matrix(spark, d):
    m = E.replication_matrix(E.collect_replication_stats(_run_stats(spark, d), ["disc"], ["repl"]), "disc", "repl", ["A", "N", "R"])
    return _round(m, "A", "N", "R")


@query("a21_pc_titration", """SELECT chr, n_pcs, ROUND(100.0 * n_eqtl / n_genes, 6) AS pct_eqtl, ROUND(SUM(explained) OVER (PARTITION BY chr ORDER BY n_pcs), 6) AS cum_explained FROM
(SELECT gene % 5 AS chr, n % 10 AS n_pcs, COUNT(DISTINCT gene) FILTER (p < 0.05) AS n_eqtl, COUNT(DISTINCT gene) AS n_genes, SUM(p) AS explained FROM v_effects GROUP BY 1, 2) x""")
def a21(spark, d):
    runs = view(spark, d, "v_effects").groupBy((F.col("gene") % 5).alias("chr"), (F.col("n") % 10).alias("n_pcs")).agg(F.count_distinct(F.when(F.col("p") < 0.05, F.col("gene"))).alias("n_eqtl"), F.count_distinct("gene").alias("n_genes"), F.sum("p").alias("explained"))
    return _round(E.pc_titration(runs, ["chr"]), "pct_eqtl", "cum_explained").select("chr", "n_pcs", "pct_eqtl", "cum_explained")


@query("j19_heterogeneity", """SELECT a.gene, a.snp, CASE WHEN a.p <= 0.5 AND COALESCE(r.p <= 0.5, FALSE) THEN 'Both' WHEN a.p <= 0.5 THEN 'Discovery' WHEN r.p <= 0.5 THEN 'Replication' ELSE 'Neither' END AS signif, (a.n % 7)::DOUBLE AS i2, unnest(['x', 'y']) AS dataset, unnest([abs(a.z), abs(a.beta)]) AS abs_z
FROM (SELECT * FROM v_study WHERE flag = 'A' AND n % 7 > 0) a LEFT JOIN (SELECT * FROM v_study WHERE flag = 'R') r ON a.gene = r.gene AND a.snp = r.snp""")
def j19(spark, d):
    a = _study(spark, d, "A")
    merged = E.overlap_effects(a.select("gene", "snp", "p", "beta", "ea"), _study(spark, d, "R").select("gene", "snp", "p", "beta", "ea"))
    meta = a.select("gene", "snp", F.when(F.col("n") % 7 > 0, (F.col("n") % 7).cast("double")).alias("i2"), F.create_map(F.lit("x"), F.col("z"), F.lit("y"), F.col("beta")).alias("z"))
    return E.heterogeneity_by_replication(merged, meta, 0.5)


@query("j3_lookup_counts", """WITH w AS (SELECT DISTINCT gene, snp FROM v_effects WHERE flag = 'A' AND p < 0.3), e AS (SELECT gene, snp FROM v_effects WHERE flag = 'R' AND gene % 3 > 0)
SELECT COUNT(*) AS wanted, COUNT(*) FILTER ((gene, snp) IN (SELECT (gene, snp) FROM e)) AS found, COUNT(*) FILTER (gene NOT IN (SELECT gene FROM e)) AS missing_gene, COUNT(*) FILTER (gene IN (SELECT gene FROM e) AND (gene, snp) NOT IN (SELECT (gene, snp) FROM e)) AS missing_pair FROM w""")
def j3(spark, d):
    e = view(spark, d, "v_effects")
    return E.lookup_counts(e.where("flag = 'R' AND gene % 3 > 0"), e.where("flag = 'A' AND p < 0.3"))


@query("j4_overlap_full", """SELECT a.gene, a.snp, COALESCE(a.ea <> r.ea, FALSE) AS flipped, CASE WHEN a.ea <> r.ea THEN -r.beta ELSE r.beta END AS repl_beta, CASE WHEN a.ea <> r.ea THEN -r.z ELSE r.z END AS repl_z, ROUND(CASE WHEN a.ea <> r.ea THEN 1 - r.af ELSE r.af END, 6) AS repl_af, a.ea AS repl_ea, a.oa AS repl_oa
FROM (SELECT * FROM v_study WHERE flag = 'A') a LEFT JOIN (SELECT * FROM v_study WHERE flag = 'R') r ON a.gene = r.gene AND a.snp = r.snp""")
def j4(spark, d):
    return _round(E.overlap_effects(_study(spark, d, "A"), _study(spark, d, "R")), "repl_af").select("gene", "snp", "flipped", "repl_beta", "repl_z", "repl_af", "repl_ea", "repl_oa")


@query("w4_allbutfirst", "SELECT gene, snp, arg_min(p, p) AS p, arg_min(ea, p) FILTER (n % 4 > 0) AS ea FROM v_effects GROUP BY gene, snp")
def w4_first(spark, d):
    e = view(spark, d, "v_effects").select("gene", "snp", "p", F.when(F.col("n") % 4 > 0, F.col("ea")).alias("ea"))
    return E.drop_duplicates(e, ["gene", "snp"], "allbutfirst", order=["p"])


@query("w4_mismatched", "SELECT gene, snp, flag FROM (SELECT *, COUNT(*) OVER (PARTITION BY gene, snp) AS k FROM v_effects WHERE flag <> 'A') x WHERE k = 1 OR (gene, snp, ea) IN (SELECT (gene, snp, ea) FROM v_effects WHERE flag = 'A')")
def w4_mismatched(spark, d):
    e = view(spark, d, "v_effects")
    return E.drop_duplicates(e.where("flag <> 'A'"), ["gene", "snp"], "mismatched", reference=e.where("flag = 'A'")).select("gene", "snp", "flag")


@query("w12_fdr", f"""WITH g AS (SELECT gene FROM v_expr GROUP BY gene ORDER BY AVG(value) DESC, gene LIMIT 150), e AS (SELECT flag, gene, snp, p FROM v_effects WHERE gene IN (SELECT gene FROM g))
SELECT flag, gene, snp, ROUND(LEAST(1.0, pi0) * {_BH}, 6) AS q, ROUND({_BH}, 6) AS bh FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY flag ORDER BY p) AS r, COUNT(*) OVER (PARTITION BY flag) AS m FROM e) x JOIN (SELECT flag, {_PI0} AS pi0 FROM e GROUP BY flag) y USING (flag)""")
def w12(spark, d):
    e = view(spark, d, "v_effects").join(X.top_expressed_genes(view(spark, d, "v_expr"), 150), "gene", "left_semi")
    return _round(R.fdr_rates(e, "p", ["flag"], "bh", "q").select("flag", "gene", "snp", "q", "bh"), "q", "bh")


@query("h20_meta_p", f"SELECT gene, snp, n_datasets, n, ROUND(z, 6) + 0 AS z, ROUND({_two_sided('z')}, 6) AS p FROM (SELECT gene, snp, COUNT(*) AS n_datasets, CAST(SUM(n) AS BIGINT) AS n, SUM(sqrt(n) * z) / sqrt(SUM(n)) AS z FROM v_study GROUP BY gene, snp HAVING COUNT(*) >= 2) x")
def h20(spark, d):
    return _round(G.meta_analyse_p(_study(spark, d)), "z", "p").withColumn("z", F.col("z") + 0.0)


_HWE = """SELECT snp, n0, n1, n2, list_transform(range(m % 2, m + 1, 2), lambda h: h * ln(2) - lgamma((m - h) / 2 + 1.0) - lgamma(h + 1.0) - lgamma(n0 + n1 + n2 - h - (m - h) / 2 + 1.0)) AS w, n1 * ln(2) - lgamma((m - n1) / 2 + 1.0) - lgamma(n1 + 1.0) - lgamma(n0 + n2 + n1 - n1 - (m - n1) / 2 + 1.0) AS o
FROM (SELECT *, n1 + 2 * LEAST(n0, n2) AS m FROM (SELECT snp, COUNT(*) FILTER (dosage = 0) AS n0, COUNT(*) FILTER (dosage = 1) AS n1, COUNT(*) FILTER (dosage = 2) AS n2 FROM v_genotypes_all GROUP BY snp) a) b"""


@query("a22_hwe", f"SELECT snp, n0, n1, n2, ROUND(LEAST(1.0, list_sum(list_transform(list_filter(w, lambda x: x <= o + 1e-9), lambda x: exp(x - o))) / list_sum(list_transform(w, lambda x: exp(x - o)))), 6) AS hwe FROM ({_HWE}) c")
def a22(spark, d):
    return _round(G.with_hwe(G.variant_stats(view(spark, d, "v_genotypes_all"))), "hwe").select("snp", "n0", "n1", "n2", "hwe")


@query("f12_filter_variants_full", f"""WITH h AS (SELECT snp, LEAST(1.0, list_sum(list_transform(list_filter(w, lambda x: x <= o + 1e-9), lambda x: exp(x - o))) / list_sum(list_transform(w, lambda x: exp(x - o)))) AS hwe FROM ({_HWE}) c)
SELECT snp FROM h JOIN (SELECT snp, chr, (snp * 37 % 100) / 100.0 AS r2 FROM v_variants) v USING (snp) WHERE hwe >= 1e-60 AND r2 >= 0.3 AND chr = 3 UNION ALL SELECT snp FROM h JOIN (SELECT snp, chr, (snp * 37 % 100) / 100.0 AS r2 FROM v_variants) v USING (snp) WHERE hwe >= 1e-60 AND r2 >= 0.3 AND chr <> 3""")
def f12(spark, d):
    v = view(spark, d, "v_variants").select("snp", "chr", (F.col("snp") * 37 % 100 / 100.0).alias("r2"))
    stats, least = G.with_hwe(G.variant_stats(view(spark, d, "v_genotypes_all"))).join(v, "snp"), {"hwe": 1e-60, "r2": 0.3}
    return G.filter_variants(stats, least, chromosome="3").union(G.filter_variants(stats, least).where("chr <> 3")).select("snp")


@query("f18_demultiplex_variants", """WITH s AS (SELECT snp, SUM(dosage) / 2 / COUNT(*) AS af FROM v_genotypes_all WHERE dosage IS NOT NULL GROUP BY snp), v AS (SELECT snp, chr, pos, string_split(alleles, '/')[1] AS ref, string_split(alleles, '/')[2] AS alt, (snp * 37 % 100) / 100.0 AS r2 FROM v_variants)
SELECT snp, chr, pos, ROUND(LEAST(af, 1 - af), 6) AS maf FROM v JOIN s USING (snp) WHERE r2 >= 0.3 AND length(ref) = 1 AND length(alt) = 1 AND LEAST(af, 1 - af) >= 0.05 AND EXISTS (SELECT 1 FROM v_genes g WHERE g.chr = v.chr AND v.pos > g.chr_start * 1 AND v.pos <= g.chr_end + 300000)""")
def f18(spark, d):
    a = F.split("alleles", "/")
    v = view(spark, d, "v_variants").select("snp", "chr", "pos", a[0].alias("ref"), a[1].alias("alt"), (F.col("snp") * 37 % 100 / 100.0).alias("r2"))
    exons = view(spark, d, "v_genes").select("chr", F.col("chr_start").alias("start"), (F.col("chr_end") + 300000).alias("end"))
    return _round(G.select_demultiplex_variants(view(spark, d, "v_genotypes_all").where("dosage IS NOT NULL"), v, exons), "maf").select("snp", "chr", "pos", "maf")


def _published(spark, d):
    """Effects as one of the public sources writes them."""
    e = _study(spark, d, "A")
    return e.select(
        F.concat(F.lit("ENSG"), F.col("gene"), F.lit(".7")).alias("Gene"), F.concat(F.lit("S"), F.col("gene")).alias("GeneSymbol"), F.concat(F.lit("1:"), F.col("snp") * 10, F.lit(":rs"), F.col("snp"), F.lit(":A_G")).alias("SNP"), F.lit("1").alias("SNPChr"),
        (F.col("snp") * 10).cast("string").alias("SNPPos"), F.col("alleles").alias("SNPAlleles"), F.col("ea").alias("SNPEffectAllele"), F.col("beta").cast("string").alias("MetaR"), F.lit(None).cast("string").alias("MetaSE"), (F.col("p") * 1.5).cast("string").alias("MetaP"),
        F.concat(F.col("n"), F.lit(".0")).alias("MetaPN"), F.lit("0.5").alias("qval"),
    )


@query("f3_source_specs", "SELECT 'S' || gene AS gene_symbol, 'ENSG' || gene AS gene_id, 'rs' || snp AS rsid, '1:' || snp * 10 AS position, alleles, ea, beta, ROUND(p * 1.5, 6) AS p, n, 'ENSG' || gene || '_1:' || snp * 10 AS key FROM v_study WHERE flag = 'A' AND p * 1.5 <= 1")
def f3(spark, d):
    raw = _published(spark, d)
    return _round(G.standardize_all(raw, source_specs("meta_analysis", raw), include_fdr=False), "p").drop("gene", "snp")


@query("f2_column_specs", "SELECT 'S' || gene AS gene_symbol, '1_' || snp * 10 AS position, CASE ea WHEN 'A' THEN 'adenine' END AS ea, 77 AS n, 'S' || gene || '_1_' || snp * 10 AS key FROM v_study WHERE flag = 'A'")
def f2(spark, d):
    declared = {"gene_symbol": "GeneSymbol", "position": [["SNPChr", "([0-9]+)", "_"], ["SNPPos", None, None]], "ea": [["SNPEffectAllele", {"A": "adenine"}, None]], "N": 77}
    specs, n = G.load_column_specs(json.dumps(declared))
    return G.fill_missing_stats(G.standardize_all(_published(spark, d), specs, "gene_symbol"), n=n).drop("gene", "snp")


@query("f5_first_name", "SELECT flag, gene, snp, symbol FROM v_effects LEFT JOIN (SELECT gene % 50 AS gene, arg_min(symbol, gene) AS symbol FROM v_genes GROUP BY 1) g USING (gene)")
def f5(spark, d):
    genes = view(spark, d, "v_genes").select((F.col("gene") % 50).alias("gene"), F.col("gene").alias("at"), "symbol")
    return G.translate_genes(view(spark, d, "v_effects"), genes, "gene", "symbol", order="at").select("flag", "gene", "snp", "symbol")


@query("f6_inferred_stats", f"""SELECT gene, snp, ROUND(z, 6) AS z, ROUND(1 / sqrt(2 * maf * (1 - maf) * (n + z * z)), 6) AS beta_se, ROUND({_two_sided('z')}, 6) AS p FROM (SELECT gene, snp, n, LEAST(af, 1 - af) AS maf,
sign(beta) * sqrt(2 * LEAST(af, 1 - af) * (1 - LEAST(af, 1 - af)) * beta * beta * n / (1 - 2 * LEAST(af, 1 - af) * (1 - LEAST(af, 1 - af)) * beta * beta)) AS z FROM v_study WHERE flag = 'A') x""")
def f6(spark, d):
    return _round(G.fill_missing_stats(_study(spark, d, "A").select("gene", "snp", "beta", "af", "n")), "z", "beta_se", "p").select("gene", "snp", "z", "beta_se", "p")


@query("f11_barcode_key", "SELECT barcode, split_part(barcode || '-1', '-', 1) || '_' || pool AS key FROM v_cells")
def f11(spark, d):
    return view(spark, d, "v_cells").select("barcode", S.barcode_key(F.concat(F.col("barcode"), F.lit("-1")), F.col("pool")).alias("key"))


@query("f20_groups", """SELECT flag, gene, snp, CASE WHEN p <= 0.3 AND beta <= 0 THEN 'Both' WHEN p <= 0.3 THEN 'Discovery' WHEN beta <= 0 THEN 'Replication' ELSE 'Neither' END AS signif,
CASE WHEN p > 0.2 AND p < 0.8 AND beta > 0.2 AND beta < 0.8 THEN 'both' WHEN p > 0.2 AND p < 0.8 THEN 'x' WHEN beta > 0.2 AND beta < 0.8 THEN 'y' ELSE 'neither' END AS bounds FROM v_effects""")
def f20(spark, d):
    p, b = F.col("p"), F.col("beta")
    return view(spark, d, "v_effects").select("flag", "gene", "snp", S.signif_group(p, b + 0.3, 0.3).alias("signif"), S.bounds_group(p, b, 0.2, 0.8, ("x", "y")).alias("bounds"))


@query("f9_concat_variant", "SELECT snp, chr || ':' || pos || ':' || array_to_string(list_sort(string_split(alleles, '/')), ':') AS variant FROM v_variants")
def f9(spark, d):
    v = view(spark, d, "v_variants")
    return v.select("snp", S.concat_variant(F.concat_ws(":", "chr", "pos", F.replace("alleles", F.lit("/"), F.lit(":")))).alias("variant"))


@query("f10_minus_log10", "SELECT flag, gene, snp, ROUND(-log10(p), 6) AS score FROM v_effects")
def f10(spark, d):
    return view(spark, d, "v_effects").select("flag", "gene", "snp", F.round(S.minus_log10(F.col("p")), 6).alias("score"))
