"""Every reference query with SQL, against DuckDB on the smallest tables."""

import math
from statistics import NormalDist

import duckdb
import pytest
from pyspark.sql import functions as F

from cellqtl.functions.scalars import pvalue_to_zscore
from cellqtl.operators.expression import inverse_normal_rank
from cellqtl.operators.genetics import rb
from cellqtl.plans.queries import QUERIES, SQL, entry_query

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    r = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())


def test_zscores_follow_the_normal_distribution(spark):
    p = [1e-300, 1e-20, 1e-5, 0.03, 0.4, 0.8, 0.999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", pvalue_to_zscore(F.col("p")).alias("z")).collect()
    for r in got:
        assert math.isclose(r.z, NormalDist().inv_cdf(r.p / 2), rel_tol=1e-9, abs_tol=1e-12)


def test_inverse_normal_ranks_follow_the_normal_distribution(spark):
    e = spark.createDataFrame([("g", s, v) for s, v in enumerate([5.0, 1.0, 5.0, 9.0])], "gene string, sample int, value double")
    got = {r["sample"]: r for r in inverse_normal_rank(e).collect()}
    assert [got[s]["u"] for s in range(4)] == [0.5, 0.2, 0.5, 0.8]
    assert all(math.isclose(r["z"], NormalDist().inv_cdf(r["u"]), abs_tol=1e-9) for r in got.values())


def test_rb_standard_error_leaves_out_each_row(spark):
    data = [(0.1, 0.2), (0.4, 0.3), (-0.3, -0.1), (0.7, 0.9), (0.2, -0.2)]
    errors = [(0.01 + i / 1000, 0.02 - i / 1000) for i in range(5)]

    def estimate(keep):
        rows, se = [data[i] for i in keep], [errors[i] for i in keep]
        n, (x, y) = len(rows), zip(*rows, strict=True)
        mx, my = sum(x) / n, sum(y) / n
        cov = sum((a - mx) * (b - my) for a, b in rows) / (n - 1)
        va, vb = sum((a - mx) ** 2 for a in x) / (n - 1) - sum(u * u for u, _ in se) / n, sum((b - my) ** 2 for b in y) / (n - 1) - sum(v * v for _, v in se) / n
        return max(-1.0, min(1.0, cov / math.sqrt(va * vb)))

    out = [estimate([j for j in range(5) if j != i]) for i in range(5)]
    mean = sum(out) / 5
    rows = [(a, u, b, v) for (a, b), (u, v) in zip(data, errors, strict=True)]
    got = rb(spark.createDataFrame(rows, "b1 double, se1 double, b2 double, se2 double")).first()
    assert math.isclose(got["rb"], estimate(range(5)), rel_tol=1e-9)
    assert math.isclose(got["se"], math.sqrt(4 / 5 * sum((o - mean) ** 2 for o in out)), rel_tol=1e-9)
    assert math.isclose(got["p"], math.erfc(abs(got["rb"] / got["se"]) / math.sqrt(2)), rel_tol=1e-7)


def test_entry_has_rows(spark):
    assert entry_query(spark, DIR).limit(1).count() == 1


GENOTYPES = "s3_read_vcf f17_split_multiallelic a22_variant_stats f12_filter_variants j10_genotype_concordance j11_sample_overlap j18_attach_variant_info u4_merge_vcfs".split()


@pytest.mark.parametrize("name", GENOTYPES)
def test_genotype_queries_have_a_form_without_a_filter(spark, con, name):
    assert f"{name}_all" in QUERIES and QUERIES[f"{name}_all"](spark, DIR).limit(1).count() == 1


def test_genotypes_are_of_every_line_item(spark, con):
    want = con.sql("SELECT COUNT(*) FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x").fetchall()[0][0]
    assert QUERIES["a22_variant_stats_all"](spark, DIR).agg(F.sum("n")).first()[0] == want
    assert QUERIES["u4_merge_vcfs_all"](spark, DIR).count() == want


@pytest.mark.parametrize("name", "w10_inverse_normal_rank_all h4_average_ranks_all h16_matched_correlation_all s8_matrix_all".split())
def test_expression_queries_have_a_form_on_all_genes(spark, con, name):
    want = con.sql("SELECT COUNT(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]
    assert QUERIES[name](spark, DIR).select("gene").distinct().count() == want


@pytest.mark.parametrize("name", "h16_spearman_all h7_outliers_all".split())
def test_expression_queries_have_a_form_on_all_samples(spark, con, name):
    want = con.sql("SELECT COUNT(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]
    assert QUERIES[name](spark, DIR).count() == want


def test_combined_and_filtered_expression_is_not_empty(spark):
    assert all(QUERIES[n](spark, DIR).limit(1).count() for n in ("u2_combine_expression_all", "h11_filter_genes_all", "w12_top_expressed_genes_all"))
