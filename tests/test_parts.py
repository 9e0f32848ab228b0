"""Batches of groups, threshold grids, headers, dictionaries, orientation, replication from sources: cases that the tables do not hold."""

import random
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellqtl.operators import effects as E
from cellqtl.operators import expression as X
from cellqtl.operators import genetics as G
from cellqtl.operators import matrix as M
from cellqtl.operators import metadata as N
from cellqtl.operators.replication import Study, prepared, replicate, titrated
from cellqtl.sources import tables as T


def greedy(genes, n, overflow):
    groups = {}
    for gene, group, chromosome, start in genes:
        at = (not chromosome.isdigit(), int(chromosome) if chromosome.isdigit() else 0, chromosome, start, gene)
        first, k = groups.get(group, (at, 0))
        groups[group] = min(first, at), k + 1
    batch, fill, out = 0, 0, {}
    for group, (_, k) in sorted(groups.items(), key=lambda x: (x[1][0][:4], x[0])):
        if fill and (fill >= n or fill + k > n + overflow):
            batch, fill = batch + 1, 0
        fill += k
        out[group] = batch
    return out


@pytest.mark.parametrize(("n", "overflow", "most"), [(10, 3, 6), (5, 0, 9), (3, 2, 1), (40, 5, 60)])
def test_batches_of_groups(spark, n, overflow, most):
    rng = random.Random(n)
    genes = [(f"g{i}_{k}", f"G{i}", rng.choice(("1", "2", "10", "X", "MT")), rng.randrange(1000)) for i in range(150) for k in range(rng.randint(1, most))]
    df = spark.createDataFrame(genes, "gene string, group string, chr string, chr_start long").repartition(3)
    got = {r.group: r.batch for r in N.grouped_batches(df, n, overflow).collect()}
    assert got == greedy(genes, n, overflow)
    assert N.grouped_batches(df.where("false"), n, overflow).count() == 0


def test_threshold_grid(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("a", None)), rng.random() < 0.8, rng.choice((None, 1.0, 2.0, 3.0, 4.5)), rng.choice((0, 5, 9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "kind string, ok boolean, x double, y int")
    got = {(r.kind, r.at_x, r.at_y): tuple(r)[3:] for r in N.threshold_grid(df, {"x": (F.col("x"), "min", [3, 1, 3]), "ok": F.col("ok"), "y": (F.col("y"), "max", [9, 4])}, ["kind"]).collect()}
    want = {}
    for kind, tx, ty in product(("a", None), (1.0, 3.0), (9.0, 4.0)):
        own = [r for r in rows if r[0] == kind]
        x = [r for r in own if r[2] is not None and r[2] >= tx]
        ok = [r for r in x if r[1]]
        want[kind, tx, ty] = len(own), len(x), len(ok), len([r for r in ok if r[3] <= ty])
    assert got == want


def test_orientation(spark):
    cov = spark.createDataFrame([("s1", "age", "3"), ("s2", "age", "4"), ("zz", "age", "9")], "sample string, covariate string, value string")
    turned = cov.selectExpr("covariate AS sample", "sample AS covariate", "value")
    want = [("s1", "age", "3"), ("s2", "age", "4")]
    for samples in (["s1", "s2", "other"], ["s1", "s2"]):
        known = spark.createDataFrame([(s,) for s in samples], "sample string")
        assert sorted(map(tuple, M.oriented(cov, known).collect())) == want == sorted(map(tuple, M.oriented(turned, known).collect()))
    with pytest.raises(PySparkException):
        M.oriented(cov, spark.createDataFrame([("q",)], "sample string")).collect()


def test_shards_of_unlike_headers(spark, tmp_path):
    for name, text in {"a-1": "x\ty\n1\t2\n", "a-2": "y\tz\n3\t\"q\tr\"\n", "a-3": "", "b-3": "z\tx\n5\t6\n", "b-1": "x\ty\n9\t9\n", "a-4": "x\ty\n7\t8\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    got = T.read_sharded(spark, f"{tmp_path}/a-<K>.txt", {"K": ["1", "2", "3", "4", "5"]}, f"{tmp_path}/b-<K>.txt").select("x", "y", "z").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "2", None), (None, "3", "q\tr"), ("6", None, "5"), ("7", "8", None)], key=str)
    assert T.read_sharded(spark, f"{tmp_path}/a-<K>.txt", {"K": ["1", "2"]}).count() == 2


def test_dictionaries_as_tables(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    words = spark.createDataFrame([("a", "B"), ("a", "A"), ("x", "y")], "key string, value string")
    out, specs = G.join_dictionaries(df, {"f": [("c", words, "!"), ("absent", words, "")], "g": [("c", {"b": "z"}, "")]})
    assert sorted(map(tuple, out.select(*(G.extract(out, s) for s in specs.values())).collect()), key=str) == [("A!", None), (None, "z"), (None, None)]


def test_target_depth_and_ranked_columns(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("a", 2, 6), ("b", 1, 0)], "barcode string, gene int, cnt int")
    assert sorted(((r.barcode, r.gene, r.fit) for r in X.proportional_fit(counts, target=100).collect()), key=str) == [("a", 1, 25.0), ("a", 2, 75.0), ("b", 1, None)]
    rows = [(i, i // 5, float(i % 5) if i % 3 else None, float((i * 7) % 5), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, d int, x double, y double, flat double")
    got = {(r.d, r.column_b): (r.n, r.r) for r in X.correlations_by_dataset(df, df.drop("d", "x"), ["k"], ["x"], ["y", "flat"], ["d"], "spearman").collect()}
    assert len(got) == 8 and all((r is None) == (c == "flat") for (_, c), (_, r) in got.items()) and sum(n for n, _ in got.values()) == 2 * len([r for r in rows if r[2] is not None])
    with pytest.raises(ValueError):
        X.correlations_by_dataset(df, df.drop("d"), ["k"], ["x"], ["y"], ["d"], "kendall")


PLAIN = {f: [(f, None, "")] for f in ("gene_id", "position", "alleles", "ea", "beta", "beta_se", "p", "fdr")}


def test_replication_from_sources(spark):
    """Repeated pairs, alleles that disagree or are not known, a study with its own rate, a swapped effect allele, a gene that only one study has."""
    a = [("g1", "1:5", "A/G", "A", 0.5, 0.1, 0.001), ("g1", "1:6", "A/G", "A", 0.4, 0.1, 0.2), ("g2", "1:7", "C/T", "C", -0.3, 0.1, 0.01), ("g3", "1:8", "A/T", "T", 0.2, 0.1, 0.9), ("g3", "1:8", "A/T", "T", 0.1, 0.1, 0.95), ("g4", "1:9", "A/G", "G", 0.2, 0.1, 2.0), (None, "1:9", "A/G", "G", 0.2, 0.1, 0.1)]
    b = [("g1", "1:5", "G/A", "G", -0.25, 0.1, 0.02), ("g2", "1:7", "C/A", "C", -0.3, 0.1, 0.03), ("g3", "1:8", "T/A", "T", 0.3, 0.1, 0.5)]
    c = [("g1", "1:5", None, "A", 0.7, 0.04), ("g2", "1:7", None, "T", 0.1, 0.3)]
    schema = "gene_id string, position string, alleles string, ea string, beta double, beta_se double, p double"
    one, two = (spark.createDataFrame(x, schema) for x in (a, b))
    three = spark.createDataFrame(c, "gene_id string, position string, alleles string, ea string, beta double, p double").withColumn("fdr", F.lit(0.01))
    have = lambda df: {k: v for k, v in PLAIN.items() if k in df.columns}
    studies = [Study("a", one, have(one), 100), Study("b", two, have(two), 100), Study("c", three, have(three), 100)]
    assert prepared(studies[0]).count() == 4
    pairs, stats = replicate(studies, 0.05)
    got = {(r.disc, r.repl, r.gene): (r.repl_beta, r.fdr, r.repl_fdr) for r in pairs.collect()}
    assert len(got) == 3 * 2 + 3 * 2 + 2 * 2
    assert got["a", "b", "g1"] == (0.25, pytest.approx(0.003), None) and got["a", "b", "g2"][0] is None  # other alleles
    assert got["a", "c", "g1"] == (0.7, pytest.approx(0.003), pytest.approx(0.08)) and got["a", "c", "g2"] == (-0.1, pytest.approx(0.015), pytest.approx(0.3)) and got["a", "c", "g3"][0] is None
    assert got["c", "b", "g1"][:2] == (-0.25 * -1, 0.01) and got["c", "a", "g2"][0] == 0.3
    s = {(r.disc, r.repl, r.subset): r for r in stats.collect()}
    assert s["a", "c", "disc"].n == 2 and s["a", "c", "disc"].ac == 100.0 and s["a", "b", "all"].n == 2
    with pytest.raises(ValueError):
        replicate([studies[0], studies[0]], 0.05)


def test_titrated_against_single_runs(spark):
    rng = random.Random(9)
    rows = [(k, t, f"g{g}", f"s{v}", rng.random() ** 2, rng.gauss(0, 1), 0.1, rng.choice("AG")) for k in (0, 5) for t in ("x", "y", "z") for g in range(12) for v in range(4)]
    e = spark.createDataFrame(rows, "n_pcs int, cell_type string, gene string, snp string, p double, beta double, beta_se double, ea string")
    got = {(r.n_pcs, r.disc, r.repl): (r.n, r.ac, r.r, r.rb) for r in titrated(e, 0.5).collect()}
    for k, t, u in product((0, 5), "xyz", "xyz"):
        if t == u:
            continue
        side = lambda n: e.where((F.col("n_pcs") == k) & (F.col("cell_type") == n)).drop("n_pcs", "cell_type")  # noqa: B023, E731
        want = E.replication_pipeline(side(t), side(u), 0.5)[1].where("subset = 'disc'").first()
        if want is None:
            assert (k, t, u) not in got
        else:
            assert got[k, t, u] == (want.n, pytest.approx(want.ac), want.r and pytest.approx(want.r), want.rb if want.rb is None else pytest.approx(want.rb))
    assert len(got) >= 8


def test_dense_genotypes_over_blocks(spark):
    rows = [(f"v{v}", f"s{s}", float((v + s) % 3)) for v in range(3) for s in range(600) if (v * s) % 4]
    got = N.densify_genotypes(spark.createDataFrame(rows, "snp string, sample string, dosage double")).collect()
    samples = {s for _, s, _ in rows}
    held = {(v, s): d for v, s, d in rows}
    assert len(got) == 2 * len(samples) and all(r.dosage == held.get((r.snp, r["sample"])) and (r.gt == "./.") == (r.dosage is None) for r in got)
