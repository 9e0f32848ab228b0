"""Queries of expression matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as E
from .registry import quantile_sql, query
from .views import view


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_RANKS = "SELECT gene, sample, value, (RANK() OVER (PARTITION BY gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE) / (COUNT(*) OVER (PARTITION BY gene) + 1) AS u FROM v_dense"


@query("w10_inverse_normal_rank", f"SELECT gene, sample, value, ROUND(u, 6) AS u, ROUND({quantile_sql('u')}, 6) + 0 AS z FROM ({_RANKS}) r", whole=("v_dense", "v_expr"))
def w10(spark, d, expr="v_dense"):
    return _round(E.inverse_normal_rank(view(spark, d, expr)), "u", "z").withColumn("z", F.col("z") + 0.0)


@query("h4_average_ranks", "SELECT gene, sample, RANK() OVER (PARTITION BY gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS rank FROM v_dense", whole=("v_dense", "v_expr"))
def h4(spark, d, expr="v_dense"):
    return E.average_ranks(view(spark, d, expr), "value", ["gene"]).select("gene", "sample", "rank")


@query("w12_top_expressed_genes", "SELECT gene, ROUND(AVG(value), 6) AS mean FROM v_dense GROUP BY gene ORDER BY AVG(value) DESC, gene LIMIT 20", whole=("v_dense", "v_expr"))
def w12(spark, d, expr="v_dense"):
    return _round(E.top_expressed_genes(view(spark, d, expr), 20), "mean")


@query("h11_filter_genes", """SELECT gene, n_obs, ROUND(m, 6) AS mean_cpm FROM (SELECT gene, var_samp(value) AS v, COUNT(*) FILTER (value > 0) AS n_obs, AVG(value / s * 1000000) AS m FROM v_dense
JOIN (SELECT sample, CAST(SUM(value) AS DOUBLE) AS s FROM v_dense GROUP BY sample) x USING (sample) GROUP BY gene) y WHERE v <> 0 AND n_obs > 2 AND m > 16000""", whole=("v_dense", "v_expr"))
def h11(spark, d, expr="v_dense"):
    return _round(E.filter_genes(view(spark, d, expr), 2, 16000), "mean_cpm")


@query("h13_proportional_fit", """SELECT barcode, gene, cnt, ROUND(ln(1 + cnt * m / s), 6) AS fit FROM v_counts JOIN (SELECT barcode, CAST(SUM(cnt) AS DOUBLE) AS s FROM v_counts GROUP BY barcode) x USING (barcode)
CROSS JOIN (SELECT AVG(s) AS m FROM (SELECT SUM(cnt) AS s FROM v_counts GROUP BY barcode) z) y""")
def h13(spark, d):
    return _round(E.proportional_fit(view(spark, d, "v_counts"), True), "fit")


_OTHER = "(SELECT gene, sample, value * value + gene AS value FROM v_dense)"


def _both(spark, d, expr):
    e = view(spark, d, expr, deal=("l_partkey", "o_custkey"))
    return e, e.withColumn("value", F.col("value") * F.col("value") + F.col("gene"))


@query("h16_matched_correlation", f"SELECT gene, COUNT(*) AS n, ROUND(corr(a.value::DOUBLE, b.value::DOUBLE), 6) AS r FROM v_dense a JOIN {_OTHER} b USING (gene, sample) GROUP BY gene", whole=("v_dense", "v_expr"))
def h16(spark, d, expr="v_dense"):
    return _round(E.matched_correlation(*_both(spark, d, expr), "gene"), "r")


@query("h16_spearman", f"""SELECT sample, COUNT(*) AS n, ROUND(corr(x, y), 6) AS r FROM (SELECT sample, RANK() OVER (PARTITION BY sample ORDER BY a.value) + (COUNT(*) OVER (PARTITION BY sample, a.value) - 1) / 2.0::DOUBLE AS x,
RANK() OVER (PARTITION BY sample ORDER BY b.value) + (COUNT(*) OVER (PARTITION BY sample, b.value) - 1) / 2.0::DOUBLE AS y FROM v_dense a JOIN {_OTHER} b USING (gene, sample)) q GROUP BY sample""", whole=("v_dense", "v_expr"))
def h16s(spark, d, expr="v_dense"):
    return _round(E.matched_correlation(*_both(spark, d, expr), "sample", "spearman"), "r")


@query("h17_column_correlations", """SELECT column_a, 'p' AS column_b, COUNT(*) AS n, ROUND(corr(x, p), 6) AS r FROM (SELECT unnest(['beta', 'n']) AS column_a, unnest([beta, CAST(n AS DOUBLE)]) AS x, p FROM v_effects) q GROUP BY column_a""")
def h17(spark, d):
    e = view(spark, d, "v_effects").withColumn("key", F.concat_ws("_", "flag", "gene", "snp"))
    return _round(E.column_correlations(e, e, "key", ["beta", "n"], ["p"]), "r")


@query("h7_outliers", """SELECT sample, ROUND(MAX(abs((value - m) / s)), 6) AS max_z, MAX(abs((value - m) / s)) >= 2 AS outlier FROM v_dense JOIN (SELECT gene, AVG(value) AS m, stddev_samp(value) AS s FROM v_dense GROUP BY gene) x USING (gene) WHERE gene < 3 GROUP BY sample""")
def h7(spark, d):
    return _round(E.outliers(view(spark, d, "v_dense").where("gene < 3").withColumnRenamed("gene", "component"), 2.0), "max_z")


@query("h7_outliers_all", """SELECT sample, ROUND(MAX(abs((value - m) / s)), 6) AS max_z, MAX(abs((value - m) / s)) >= 2 AS outlier FROM v_expr JOIN (SELECT gene, AVG(value) AS m, NULLIF(stddev_samp(value), 0) AS s FROM v_expr GROUP BY gene) x USING (gene) GROUP BY sample""")
def h7_all(spark, d):
    return _round(E.outliers(view(spark, d, "v_expr").withColumnRenamed("gene", "component"), 2.0), "max_z")
