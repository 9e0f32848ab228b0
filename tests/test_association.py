"""Cis association in blocks, quantiles and average ranks over ranges, against brute force."""

import math
import random
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cellqtl.functions import distributions as D
from cellqtl.operators import association as A
from cellqtl.operators import cells as C
from cellqtl.operators import genetics as G
from cellqtl.operators import order as O
from cellqtl.plans.queries import QUERIES
from cellqtl.plans.views import view


def mean_rank(values, x):
    return sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2


def test_cis_association_over_blocks(spark):
    """A bucket with more variants and genes than one block, datasets of their own samples and filters, links of other names, missing cells."""
    rng = np.random.default_rng(7)
    gte = [(f"g{i}", f"e{i}", "a" if i < 60 else "b") for i in range(90)] + [("g5", "e5", "a")]
    genes = [(f"G{i}", "1", int(rng.integers(0, 3_000_000))) for i in range(150)] + [("X", "2", 5), ("lost", None, 5)]
    variants = [(f"v{i}", "1", int(rng.integers(900_000, 1_100_000)) if i < 700 else int(rng.integers(0, 3_000_000))) for i in range(720)] + [("w", "2", 1_000_005), ("w2", "2", 1_000_006)]
    share = rng.random(len(variants))
    d = {(v[0], f"g{i}"): None if rng.random() < 0.03 else float(rng.binomial(2, 0.5 * share[k])) for k, v in enumerate(variants) for i in range(90)}
    e = {(g[0], f"e{i}"): round(float(rng.normal()), 1) for g in genes for i in range(90) if rng.random() < 0.9}
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = A.cis_association(
        df([(*k, v) for k, v in d.items()], "snp string, sample string, dosage double"), df([(*k, v) for k, v in e.items()], "gene string, sample string, value double"),
        df(gte, "genotype_id string, expression_id string, dataset string"), df(genes, "gene string, chr string, tss long"), df(variants, "snp string, chr string, pos long"), maf=0.1, call=0.95, hwe=1e-3, min_obs=20,
    ).collect()
    got = {(r.dataset, r.gene, r.snp): r for r in got}
    hwe = lambda n: D.hwe_p.func(*(pd.Series([x]) for x in n))[0]
    seen = 0
    for name, ids in (("a", range(60)), ("b", range(60, 90))):
        kept = set()
        for v, _, _ in variants:
            x = [d[v, f"g{i}"] for i in ids]
            called = [y for y in x if y is not None]
            af = sum(called) / 2 / len(called)
            if min(af, 1 - af) >= 0.1 and len(called) / len(x) >= 0.95 and hwe([called.count(k) for k in (0, 1, 2)]) >= 1e-3:
                kept.add(v)
        for g, chromosome, tss in genes:
            values = {i: e[g, f"e{i}"] for i in ids if (g, f"e{i}") in e}
            z = {i: NormalDist().inv_cdf(mean_rank(values.values(), x) / (len(values) + 1)) for i, x in values.items()}
            for v, other, pos in variants:
                r = got.pop((name, g, v), None)
                common = [i for i in z if d[v, f"g{i}"] is not None]
                if chromosome != other or abs(pos - tss) > 1_000_000 or v not in kept or len(common) < 20:
                    assert r is None
                    continue
                if g in ("G0", "G1", "G2", "G3", "G77", "X"):
                    want = np.corrcoef([z[i] for i in common], [d[v, f"g{i}"] for i in common])[0, 1]
                    t = abs(want) * math.sqrt((len(common) - 2) / (1 - want**2))
                    assert r.n == len(common) and r.distance == pos - tss and abs(r.r - want) < 1e-7 and 0 < r.p < 1 and (t < 3) == (r.p > 0.0045) or 2.7 < t < 3.3
                    assert math.isclose(abs(r.z), NormalDist().inv_cdf(1 - r.p / 2), rel_tol=1e-6) and r.z * r.r > 0
                    seen += 1
                assert r is not None
    assert not got and seen > 500


def test_average_ranks_and_quantiles(spark):
    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.05 else v, i) for g, n in (("a", 900), (None, 40), ("b", 1), ("c", 2)) for i in range(n) for v in [rng.choice((0.0, -0.0, 1.5, float(rng.randrange(60))))]]
    rows += [("none", None, 0)] + [("hot", 3.0, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(7)
    of = defaultdict(list)
    for g, v, _ in rows:
        of[g].append(v)
    held = {g: sorted(v for v in vs if v is not None) for g, vs in of.items()}
    got = O.average_ranks(df, "v", ["g"]).collect()
    assert len(got) == len(rows)
    ranks = {(g, v): mean_rank(vs, v) for g, vs in held.items() for v in set(vs)}
    assert all(r["rank"] == (None if r.v is None else ranks[r.g, r.v]) for r in got)
    wanted = {"low": 0, "q": 0.3, "median": 0.5, "high": 1}
    q = {r.g: r for r in O.quantiles(df, "v", ["g"], wanted).collect()}
    assert set(q) == {g for g, v in held.items() if v}
    for g, r in q.items():
        for n, f in wanted.items():
            assert math.isclose(r[n], np.quantile(held[g], f), abs_tol=1e-12)
    everything = [v for vs in held.values() for v in vs]
    assert O.quantiles(df, "v", [], {"m": 0.5}).collect() == [(np.median(everything),)]
    assert O.quantiles(df.where("false"), "v", ["g"], wanted).count() == 0
    mad = {r.g: r for r in C.mad_thresholds(df, "v", ["g"], [2.0]).collect()}
    assert all(math.isclose(r.mad, 1.4826 * np.median(np.abs(np.array(held[g]) - np.median(held[g]))), abs_tol=1e-12) for g, r in mad.items())


def test_hardy_weinberg_by_ratio(spark):
    rows = [(0, 0, 5), (0, 7, 0), (3, 0, 4), (57, 14, 50), (400, 90, 7), (57, 14, 50), (1, 0, 0)]
    df = spark.createDataFrame(rows, "n0 long, n1 long, n2 long")
    got = [tuple(r) for r in G.with_hwe(df).collect()]
    assert len(got) == len(rows)
    for a, h, b, p in got:
        n, rare = a + h + b, h + 2 * min(a, b)
        w = {k: 2.0**k * math.comb(n, k) * math.comb(n - k, (rare - k) // 2) for k in range(rare % 2, rare + 1, 2)}
        assert math.isclose(p, sum(x for x in w.values() if x <= w[h] * (1 + 1e-9)) / sum(w.values()), rel_tol=1e-9)


def test_the_association_query_takes_every_step_of_the_method(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["h19_cis_association"](spark, d)
    assert got.columns == ["dataset", "gene", "snp", "distance", "n", "r", "p", "z"]  # these three were left out, so no correlation was computed
    rows = got.collect()
    genes, variants = ({r[0]: (r.chr, r[2]) for r in view(spark, d, v).select(k, "chr", at).collect()} for v, k, at in (("v_genes", "gene", "chr_start"), ("v_variants", "snp", "pos")))
    near = {(g, s): p - t for g, (c, t) in genes.items() for s, (k, p) in variants.items() if c == k and abs(p - t) <= 1_000_000}
    assert all(near.get((r.gene, r.snp)) == r.distance for r in rows)  # pairs of any distance were tested
    stats = G.with_hwe(G.variant_stats(view(spark, d, "v_genotypes_all").withColumn("dataset", F.col("sample") % 2), ("dataset", "snp"))).collect()
    passed = {(r.dataset, r.snp) for r in stats if r.maf >= 0.3 and r.call >= 0.93 and r.hwe >= 1e-12}
    assert 0 < len({(r.dataset, r.snp) for r in rows}) and {(r.dataset, r.snp) for r in rows} <= passed
    told = [r for r in rows if r.n > 2 and r.r is not None and 0 < r.p < 1]
    assert len(told) > 50 and all(r.r * r.z > 0 and abs(abs(r.z) - NormalDist().inv_cdf(1 - r.p / 2)) < 1e-2 for r in told if r.p > 1e-3)


def test_correlations_of_one_do_not_hang_on_their_last_bits(spark):
    y = np.array([0.1, 0.7, 0.1, 0.3, 1.3]) * 0.1
    sides = [pa.table({"k": pa.array([range(5)] * 2, pa.list_(pa.int32())), name: pa.array([x, -x], pa.list_(pa.float64())), at: pa.array([0, 1])}) for name, at, x in (("y", "tss", y), ("g", "pos", y * 3))]
    assert A._correlated(*sides, 10, 2)[3].tolist() == [1, -1, -1, 1]
