"""What SQL cannot say: distribution functions, components, association, specs, files; and edge cases of ranks and rates."""

import math
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellqtl.functions import distributions as D
from cellqtl.operators import effects as E
from cellqtl.operators import genetics as G
from cellqtl.operators import matrix as M
from cellqtl.operators import metadata as T
from cellqtl.operators import ranking as R
from cellqtl.plans.views import view
from cellqtl.sources import genome, tables
from cellqtl.sources.effects import SPECS, source_specs

DIR = "/root/testdata/sf0.001"


def test_normal_distribution(spark):
    z = [0.0, 0.3, -1.0, 2.5, -6.9, 7.5, 12.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", D.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-7) for r in got)


def test_beta_distribution():
    for a, b in ((1, 5), (3, 2), (7, 11)):
        for x in (0.01, 0.3, 0.5, 0.93):
            n = a + b - 1
            want = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
            assert math.isclose(float(D.beta_cdf(x, a, b)), want, rel_tol=1e-12)
            assert math.isclose(float(D.beta_quantile(want, a, b)), x, rel_tol=1e-9)
    assert float(D.beta_cdf(0, 2, 3)) == 0 and float(D.beta_cdf(1, 2, 3)) == 1
    # with one degree of freedom Student's t is Cauchy's distribution
    t = 2.7
    assert math.isclose(float(D.beta_cdf(1 / (1 + t * t), 0.5, 0.5)), 1 - 2 / math.pi * math.atan(t), rel_tol=1e-12)


def test_smoother_has_its_degrees_of_freedom_and_keeps_lines():
    w = R.smoother_weights()
    x = np.array(R.LAMBDAS)
    assert math.isclose(w.sum(), 1, abs_tol=1e-9) and math.isclose(w @ (2 * x + 1), 2 * x[-1] + 1, abs_tol=1e-8)
    rows = [R.smoother_weights(R.LAMBDAS, 3)]
    assert abs(rows[0][-1] - 0.34) < 0.02  # the last point's share in its own value


def test_rates_with_nulls_ties_and_several_runs(spark):
    rng = np.random.default_rng(4)
    rows = [(r, float(p)) for r in ("a", None) for p in [*rng.random(200).round(2), *[1.0] * 150]] + [("a", None), ("b", 0.2)]
    got = defaultdict(list)
    for r in R.bh_fdr(spark.createDataFrame(rows, "run string, p double"), "p", ["run"]).collect():
        got[r.run].append((r.p, r.fdr))
    assert sum(map(len, got.values())) == len(rows) and (None, None) in got["a"] and got["b"] == [(0.2, 0.2)]
    for run in ("a", None):
        p = sorted(x for r, x in rows if r == run and x is not None)
        rate, least = {}, 1.0
        for k in range(len(p), 0, -1):
            least = min(least, p[k - 1] * len(p) / k)
            rate.setdefault(p[k - 1], least)
        assert all(math.isclose(q, rate[x], rel_tol=1e-9) for x, q in got[run] if x is not None)
    empty = spark.createDataFrame([], "run string, p double")
    assert R.bh_fdr(empty, "p", ["run"]).count() == 0 and R.qvalues(empty, "p", ["run"]).count() == 0


def test_components_match_a_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 40))
    x[:, 3] = 1.0  # does not vary
    rows = [(f"g{j:02}", f"s{i}", float(x[i, j])) for i in range(6) for j in range(40)]
    out = M.pca(spark.createDataFrame(rows, "gene string, sample string, value double"), 3)
    z = np.delete(x, 3, 1)
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), range(u.shape[1])])
    scores = {(r["sample"], r["component"]): r["score"] for r in out["scores"].collect()}
    assert len(scores) == 18 and all(math.isclose(scores[f"s{i}", k + 1], (u * s * sign)[i, k], abs_tol=1e-8) for i in range(6) for k in range(3))
    pct = {r["component"]: r["pct"] for r in out["variance"].collect()}
    assert all(math.isclose(pct[k + 1], 100 * s[k] ** 2 / (s**2).sum(), rel_tol=1e-8) for k in range(3))
    weight = {(r["gene"], r["component"]): r["weight"] for r in out["rotation"].collect()}
    names = [f"g{j:02}" for j in range(40) if j != 3]
    assert all(math.isclose(weight[g, 1], vt[0, j] * sign[0], abs_tol=1e-8) for j, g in enumerate(names)) and len(weight) == 39 * 3


def test_cis_association_matches_brute_force(spark):
    pairs = view(spark, DIR, "v_effects").where("flag = 'A' AND gene < 12").select("gene", "snp")
    e = view(spark, DIR, "v_expr").withColumn("dataset", F.col("sample") % 2)
    g = view(spark, DIR, "v_genotypes_all")
    got = {(r.dataset, r.gene, r.snp): r for r in M.pair_association(pairs, g, e, 3).collect()}
    values, dosage = defaultdict(dict), {(r.snp, r["sample"]): r.dosage for r in g.collect() if r.dosage is not None}
    for r in e.collect():
        values[r.dataset, r.gene][r["sample"]] = float(r.value)
    want = {}
    for gene, snp in {tuple(r) for r in pairs.collect()}:
        for d in (0, 1):
            v = values[d, gene]
            rank = {s: sum(w < x for w in v.values()) + (sum(w == x for w in v.values()) + 1) / 2 for s, x in v.items()}
            both = [(NormalDist().inv_cdf(rank[s] / (len(v) + 1)), dosage[snp, s]) for s in v if (snp, s) in dosage]
            if len(both) >= 3:
                x, y = map(np.array, zip(*both, strict=True))
                want[d, gene, snp] = len(both), (np.corrcoef(x, y)[0, 1] if x.std() > 1e-12 and y.std() > 0 else None)
    assert set(got) == set(want) and len(want) > 3
    for k, (n, r) in want.items():
        assert got[k].n == n
        if r is not None:
            assert math.isclose(got[k].r, r, abs_tol=1e-6) and 0 <= got[k].p <= 1 and (abs(got[k].z) < 1e-9 or math.copysign(1, got[k].z) == math.copysign(1, r))


def test_specs_of_every_source(spark):
    for name, specs in SPECS.items():
        used = {c.replace("<CT>", "Micro") for s in specs.values() for c in ([s] if isinstance(s, str) else [p[0] for p in s])} | ({"Beta3_Micro:GT"} if name == "cell_type_interaction" else set())
        used |= {"Gene", "SNP", "MetaR"} if name == "meta_analysis" else set()
        row = {c: None for c in used}
        found = source_specs(name, spark.createDataFrame([tuple("x" for _ in row)], ", ".join(f"`{c}` string" for c in row)), "Micro")
        assert set(specs) - {"gene_id", "rsid"} <= set(found) | {"gene_id", "rsid"} and "beta" in found or name == "probe_level"
    df = spark.createDataFrame([("ENSG12.3_7:55:rs9:A_G", "1.5", "0.2", "A", "G")], "`` string, `Beta3_Micro:GT` string, Micro_pvalue string, EA string, OA string")
    r = G.standardize_all(df, source_specs("cell_type_interaction", df, "Micro")).first()
    assert (r.gene, r.snp, r.rsid, r.alleles, r.beta, r.p) == ("ENSG12", "7:55", "rs9", "A/G", 1.5, 0.2)
    with pytest.raises(ValueError):
        source_specs("cell_type_interaction", df, "Astro")
    for bad in ('{"beta": [["x"]]}', '{"unheard_of": "x"}', "[1]", '{"beta": 3}'):
        with pytest.raises(ValueError):
            G.load_column_specs(bad)


def test_gtex_positions(spark):
    df = spark.createDataFrame([("ENSG5.2", "chr7_100_A_GT_b38", "0.5", "0.1", "180.0")], "gene_id string, variant_id string, slope string, pval_nominal string, minor_allele_count string")
    r = G.standardize_all(df, source_specs("gtex", df)).first()
    assert (r.gene, r.snp, r.alleles, r.ea, r.mac) == ("ENSG5", "7:100", "A/GT", "GT", 180) and "fdr" not in r.asDict()


def test_vcf_probabilities_and_headers(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    body = "1\t5\tv\tA\tG\t.\tPASS\tR2=0.5;T\tGT:DS:GP\t0|1:1.1:0.1,0.7,0.2\t./.:.:.\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.vcf").write_text("##x\n" + head + "s1\ts2\n" + body)
    rows = {r["sample"]: r for r in genome.genotypes_long(genome.read_vcf(spark, f"{tmp_path}/a")).collect()}
    assert rows["s1"].gp == [0.1, 0.7, 0.2] and rows["s1"].dosage == 1 and rows["s2"].dosage is None and rows["s2"].gp == [None]
    (tmp_path / "a/two.vcf").write_text("##x\n" + head + "s2\ts1\n" + body)
    with pytest.raises(ValueError):
        genome.read_vcf(spark, f"{tmp_path}/a")


def test_shards_fall_back_one_by_one(spark, tmp_path):
    for name, text in (("all-1.txt", "x\ta"), ("top-1.txt", "x\tb"), ("top-2.txt", "x\tc")):
        (tmp_path / name).write_text("k\tv\n" + text + "\n")
    got = tables.read_sharded(spark, f"{tmp_path}/all-<CHR>.txt", {"CHR": ["1", "2", "3"]}, f"{tmp_path}/top-<CHR>.txt")
    assert sorted(map(tuple, got.collect())) == [("x", "a"), ("x", "c")]
    with pytest.raises(FileNotFoundError):
        tables.read_sharded(spark, f"{tmp_path}/no-<CHR>.txt", {"CHR": ["1"]})


def test_duplicates_and_repeated_identifiers(spark):
    df = spark.createDataFrame([("g", "s", None, 2), ("g", "s", "A", 3), ("h", "s", "G", 1)], "gene string, snp string, ea string, at int")
    first = {r.gene: (r.ea, r["at"]) for r in E.drop_duplicates(df, ["gene", "snp"], "allbutfirst", order=["at"]).collect()}
    assert first == {"g": ("A", 2), "h": ("G", 1)}
    with pytest.raises(Exception, match="repeated key"):
        E.drop_duplicates(df, ["gene", "snp"], "none").collect()
    with pytest.raises(Exception, match="repeated identifier"):
        G.unique_ids(df, "gene").collect()
    with pytest.raises(Exception, match="two matrices"):
        m = spark.createDataFrame([("g", "s", 1.0)], "gene string, sample string, value double")
        T.join_corrected([m, m]).collect()


def test_rb_is_null_where_a_column_does_not_vary(spark):
    rows = [(float(i), 0.1, float(i * i % 7), 0.2 + i / 100) for i in range(9)]
    assert G.rb(spark.createDataFrame(rows, "b1 double, se1 double, b2 double, se2 double")).first().rb is None


def test_hardy_weinberg_of_known_counts(spark):
    got = {tuple(r[:3]): r[3] for r in G.with_hwe(spark.createDataFrame([(57, 14, 50), (0, 0, 5), (1, 2, 1)], "n0 long, n1 long, n2 long")).collect()}
    assert got[0, 0, 5] == 1 and math.isclose(got[1, 2, 1], 1.0) and got[57, 14, 50] < 1e-15
