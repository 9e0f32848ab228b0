"""What must hold at size: plans that shuffle or gather no more than they have to, and results that do not hang on the order of rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellqtl.operators import association as A
from cellqtl.operators import blocks as B
from cellqtl.operators import effects as E
from cellqtl.operators import expression as X
from cellqtl.operators import genetics as G
from cellqtl.operators import matrix as M
from cellqtl.operators import metadata as N
from cellqtl.operators import order as O
from cellqtl.operators import ranking as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_distance_of_the_bound_itself_is_an_outlier(spark):
    # the last value lies two standard deviations off exactly; added up in this order it comes out as 1.9999999999999998
    values = [10, 28, 27, 23, 22, 17, 26, 18, 27]
    found = X.outliers(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "component int, sample int, value long").coalesce(1), 2.0)
    assert [(r.sample, round(r.max_z, 6)) for r in found.where("outlier").collect()] == [(0, 2.0)]
    gte = spark.createDataFrame([(i, i, "x") for i in range(9)], "genotype_id int, expression_id int, dataset string")
    scores = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(values)], "sample int, component int, score double").coalesce(1)
    assert [r.expression_id for r in M.pca_outliers(scores, gte, z=2.0).where("not include").collect()] == [0]


def test_variants_in_long_short_and_overlapping_exons(spark):
    exons = [(1, 95, 2050), (1, 3, 12), (1, 14, 14), (1, 40, 60), (1, 45, 50), (1, 2300, 2310), (1, 2309, 2311), (1, 2399, 2400), (2, 0, 100), (2, 99, 199), (2, 500, 400)]
    variants = [(1000 * c + p, c, p, "A", "G", 0.9) for c, ps in ((1, [*range(0, 130), 1000, *range(2040, 2060), *range(2295, 2320), *range(2395, 2405)]), (2, [*range(0, 5), *range(95, 205), 450])) for p in ps]
    variants = [(i, *v[1:]) for i, v in enumerate(variants)]
    v = spark.createDataFrame(variants, "snp int, chr int, pos long, ref string, alt string, r2 double")
    e = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}, {s}L, {t}L)" for c, s, t in exons) + " AS t (chr, start, end)")  # of a known size
    genotypes = v.select("snp", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("dosage"))
    found = G.select_demultiplex_variants(genotypes, v, e, width=100)
    wanted = sorted((c, p) for _, c, p, *_ in variants if any(k == c and s < p <= t for k, s, t in exons))
    assert [(r.chr, r.pos) for r in found.select("chr", "pos").collect()] == wanted
    # exons in many buckets are no small table, though they come from one
    assert "BroadcastHashJoin" not in "".join(line for line in plan(found).splitlines() if "LeftSemi" in line)


def test_names_of_studies_are_told_without_a_shuffle_of_genotypes(spark):
    g = spark.range(2000).select((F.col("id") % 50).alias("snp"), F.when(F.col("id") > 0, F.floor(F.col("id") / 50)).alias("sample"), F.lit(1.0).alias("dosage"))
    merged = N.merge_genotypes({"x": g.where("snp % 2 = 0"), "y": g.where("snp % 2 = 1 AND sample % 4 = 0")})
    names = {r.sample: r.n for r in merged.groupBy("sample").agg(F.count("*").alias("n")).collect()}
    assert names == {(f"x_{s}" if s % 4 == 0 else str(s)): 25 - (s == 0) for s in range(40)} | {f"y_{s}": 25 for s in range(0, 40, 4)}
    assert "Exchange hashpartitioning" not in plan(merged)


def test_association_by_cells_that_meet_equals_dense_products(spark, monkeypatch):
    """Tile by tile, where few samples have a cell."""
    rng = np.random.default_rng(3)
    lists = lambda n, name: pa.table({"k": pa.array(ks := [np.sort(rng.choice(40, rng.integers(0, 12), False)).astype(np.int32) for _ in range(n)], pa.list_(pa.int32())), name: pa.array([rng.normal(size=len(k)) for k in ks], pa.list_(pa.float64()))})
    genes, variants = (A._cells(lists(n, "x"), "x") for n in (30, 20))
    found = []
    for tile, meet, sums in ((7, 5, 0), (1000, 1000, 0), (45, 9, 1), (1000, 1000, 1)):
        for name, value in (("TILE", tile), ("MEET", meet), ("SIDE", 25 * tile)):
            monkeypatch.setattr(A, name, value)
        parts = list(A._dense_sums(genes, variants, 30, 20) if sums else A._sparse_sums(genes, variants, 20))
        rows = np.concatenate([np.stack(p).T for p in parts])
        found.append(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
    assert len(found[0]) > 100 and all(f.shape == found[0].shape and np.allclose(f, found[0]) for f in found)


def test_blocks_of_association_follow_cells_not_samples(spark, monkeypatch):
    n = 1000  # samples of the links; four of them have cells
    gte = spark.range(n).select(F.col("id").alias("genotype_id"), F.col("id").alias("expression_id"), F.lit("x").alias("dataset"))
    ids = spark.range(60).select(F.col("id"))
    cells = lambda name: ids.select(F.col("id").alias(name), F.explode(F.lit(list(range(4)))).alias("sample"))
    e = cells("gene").withColumn("value", F.col("gene") * F.col("sample") % 7)
    g = cells("snp").withColumn("dosage", ((F.col("snp") + F.col("sample")) % 3).cast("double"))
    place = lambda name, at: ids.select(F.col("id").alias(name), F.lit(1).alias("chr"), F.col("id").alias(at))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    monkeypatch.setattr(A, "CELLS", 100)
    before = shuffled()
    got = A.cis_association(g, e, gte, place("gene", "tss"), place("snp", "pos"), maf=0.0, call=0.0, hwe=0.0, min_obs=4)
    assert got.agg(F.count(F.lit(1)), F.sum("n")).first() == (3600, 14400)
    assert shuffled() - before < 80_000


def test_sparse_tables_make_few_pieces(spark, monkeypatch):
    counts, written = [], B.written

    def counted(df, name):
        out = written(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(B, "written", counted)
    monkeypatch.setattr(B, "DENSE", 300, raising=False)
    cells = spark.range(2000).select(F.col("id").alias("row"), (F.col("id") % 4).alias("col"), F.lit(2.0).alias("x"))
    got = B.column_products(cells, spark.range(4).select(F.col("id").alias("label")), [], diagonal=True).collect()
    assert {(r.col_a, r.col_b): r.xy for r in got} == {(a, b): 2000.0 * (a == b) for a in range(4) for b in range(a + 1)}
    assert counts == [1]  # 2,000 cells, which were eight pieces by the number of their rows


def counting(spark, cells):
    """``cells`` whose values are computed row by row, and the number of rows computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def tell(v):
        seen.add(1)
        return v

    return cells.withColumn("value", F.udf(tell, "double").asNondeterministic()("value")), seen


def matrix_of(spark):
    return spark.range(40 * 6).select(F.floor(F.col("id") / 6).alias("gene"), (F.col("id") % 6).alias("sample"), (20 + F.col("id") * F.col("id") % 83 + F.col("id") % 6).cast("double").alias("value"))


def test_matrices_are_computed_once(spark):
    for run in (M.tmm_factors, lambda e: M.tmm_cpm(e), lambda e: M.log_cpm_filter(e, 1)[0], lambda e: M.log_cpm_filter(e, 1)[1], lambda e: M.pca(e, 2)["rotation"]):
        expr, seen = counting(spark, matrix_of(spark).repartition(3))
        assert run(expr).count() and seen.value == 240


def test_cuts_by_rank_are_cuts_at_values(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        x = rng.integers(0, 6, n).astype(float)
        df = spark.createDataFrame([(1, float(v)) for v in x], "sample int, x double").repartition(3)
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        for share in (0.05, 0.3):
            off = int(n * share)
            r = O.values_at(df, "x", ["sample"], {"lo": lambda k, s=share: F.floor(k * s), "hi": lambda k, s=share: k - 1 - F.floor(k * s)}).first()
            got = ((x > r.lo) | ((x == r.lo) & (r.lo_rank >= off + 1))) & ((x < r.hi) | ((x == r.hi) & (r.hi_rank <= n - off)))
            assert (got == ((ranks >= off + 1) & (ranks <= n - off))).all()


def test_rows_that_are_ranked_or_rated_are_computed_once(spark):
    ranks = lambda e: O.average_ranks(e, "value", ["sample"]).select("rank")
    rates = lambda e: R.fdr_rates(e.withColumn("p", F.col("value") / 200), "p", ["sample"], "bh", "q").select("bh", "q")
    tests = lambda e: E.multiple_testing(e.withColumns({"p": F.col("value") / 200, "k": F.lit(2)}), "p", 0.9, ["sample"], n_tests="k")
    for run in (ranks, rates, tests):
        expr, seen = counting(spark, matrix_of(spark).repartition(3))
        assert len(run(expr).collect()) == 240 and seen.value == 240


def test_effects_of_one_flag_are_chosen_before_they_are_ranked(spark):
    from cellqtl.plans.association import _flag
    from cellqtl.plans.statistics import _study

    for one in (_flag(spark, "/root/testdata/sf0.001", "A"), _study(spark, "/root/testdata/sf0.001", "A")):
        assert "EqualTo(l_returnflag,A)" in plan(one)  # the reader's, below the window


def test_rows_without_p_are_not_joined_to_rates(spark):
    rows = [(g, i, None if i % 3 else 0.001 * (i + 1)) for g in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, p double")
    got = R.fdr_rates(df, "p", ["g"], "bh", "q")
    assert got.where("p IS NULL").count() == got.where("bh IS NULL AND q IS NULL AND p IS NULL").count() == 40 and got.where("bh IS NOT NULL").count() == 20
    assert "Union" in plan(got)


def test_cis_pairs_of_one_file_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "GENES", 40, raising=False)
    genes = [(i, 1 + i % 2, i * 7919 % 3000 - 50) for i in range(200)] + [(200, 1, None), (201, None, 5)]
    variants = [(i, 1 + i % 3, i * 104729 % 3000) for i in range(100)] + [(100, 1, 1000), (101, 1, None)]
    g = spark.createDataFrame(genes, "gene int, chr int, tss long").coalesce(1)
    v = spark.createDataFrame(variants, "snp int, chr int, pos long")
    wanted = lambda w: sorted((i, j, p - t) for i, c, t in genes for j, k, p in variants if c == k and None not in (c, t, p) and abs(p - t) <= w)
    for w in (1000, 100, 3, 0):
        found = E.cis_pairs(g, v, w).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.gene, r.snp, r.distance) for r in found) == wanted(w)
        assert w < 1000 or len({r.task for r in found}) > 3


def test_dense_genotypes_compute_their_cells_once_and_keep_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLES", 7)
    rows = [(v, f"s{s}", float((v + s) % 3)) for v in range(5) for s in range(40) if v * s % 4] + [(1, "s1", 2.0), (None, "s3", 1.0), (4, None, 1.0), (4, "s0", None)]
    merged, seen = counting(spark, spark.createDataFrame(rows, "snp int, sample string, value double").repartition(3))
    got = N.densify_genotypes(merged.withColumnRenamed("value", "dosage")).collect()
    known = sorted((v, s, -1.0 if d is None else d) for v, s, d in rows if v is not None and s is not None)
    held = {(v, s) for v, s, _ in known}
    absent = [(v, s, -1.0) for v in {v for v, _, _ in rows} for s in {s for _, s, _ in rows if s} if (v, s) not in held]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.snp, r["sample"], -1.0 if r.dosage is None else r.dosage) for r in got), key=key) == sorted(known + absent, key=key)
    assert all((r.gt == "./.") == (r.dosage is None) for r in got) and seen.value == len(rows)


def test_calls_of_a_vcf_are_shuffled_as_words(spark):
    from cellqtl.plans.queries import QUERIES

    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = shuffled()
    assert QUERIES["s3_read_vcf"](spark, "/root/testdata/sf0.01").agg(F.count("*"), F.count("dosage")).first()[0] == 15000
    assert shuffled() - before < 60_000


def test_odd_calls_and_fields_in_any_place(spark, tmp_path):
    from cellqtl.sources import genome

    calls = ["0/0:5", "1|0:6", ".|.:.", "./1:7", "1/2:8", "1:9", ".:1", "1|1"]
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(8))])
    fixed = lambda i, form: f"1\t5\t{i}\tA\tG\t.\tPASS\t.\t{form}\t"
    turned = [":".join(reversed(c.split(":"))) for c in calls]
    (tmp_path / "a.vcf").write_text("##x\n" + head + "\n" + fixed("v", "GT:DS") + "\t".join(calls) + "\n" + fixed("w", "DS:GT") + "\t".join(turned) + "\n")
    rows = {(r.id, r["sample"]): (r.gt, r.dosage, r.ds) for r in genome.genotypes_long(genome.read_vcf(spark, str(tmp_path))).collect()}
    assert [rows["v", f"s{i}"][1] for i in range(8)] == [0, 1, None, None, 3, None, None, 2]
    assert [rows["v", f"s{i}"][2] for i in range(8)] == [5, 6, None, 7, 8, 9, 1, None]
    assert all(rows["v", f"s{i}"] == rows["w", f"s{i}"] for i in range(7)) and rows["w", "s7"] == (None, None, None)


def test_deltas_are_dealt_to_tasks_by_the_number_of_rows(spark, monkeypatch):
    from cellqtl.plans import views
    from cellqtl.plans.queries import QUERIES

    monkeypatch.setattr(views, "ROWS", 1000, raising=False)
    d = "/root/testdata/sf0.001"
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 1000)
    got = QUERIES["j7_count_delta"](spark, d).withColumn("task", F.spark_partition_id())
    assert tasks > 4 and got.select("task").distinct().count() == tasks


def test_matrices_that_are_matched_are_dealt_to_tasks_by_the_number_of_rows(spark, monkeypatch):
    from cellqtl.plans import views
    from cellqtl.plans.queries import QUERIES

    monkeypatch.setattr(views, "ROWS", 1000, raising=False)
    d = "/root/testdata/sf0.001"
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 1000)
    p = plan(QUERIES["h16_matched_correlation"](spark, d))
    assert tasks > 4 and p.count(f", {tasks}), REPARTITION_BY_NUM") == 2 and "Exchange hashpartitioning(gene#" in p
    assert not any("sample#" in line for line in p.splitlines() if "Exchange" in line)  # no further shuffle before the join


def test_weighted_correlation_computes_its_counts_once(spark):
    counts, seen = counting(spark, matrix_of(spark).repartition(3))
    counts = counts.select(F.col("sample").alias("barcode"), "gene", F.col("value").alias("cnt"))
    weights = spark.range(6).select(F.col("id").alias("barcode"), F.lit("x").alias("donor"), (1 + F.col("id") % 3).alias("weight"))
    got = M.weighted_gene_correlation(counts, weights, "donor", 2).collect()
    cells = np.array([r.value for r in matrix_of(spark).orderBy("gene", "sample").collect()]).reshape(40, 6)
    want = np.cov(cells, aweights=[1, 2, 3, 1, 2, 3], ddof=0)
    want /= np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert len(got) == 780 and all(abs(r.r - want[r.gene_a, r.gene_b]) < 1e-9 for r in got) and seen.value == 240


def test_counts_of_weighted_correlation_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    from cellqtl.plans import statistics, views

    monkeypatch.setattr(views, "ROWS", 1000, raising=False)
    counts, kept = [], statistics.M.weighted_gene_correlation
    monkeypatch.setattr(statistics.M, "weighted_gene_correlation", lambda c, *a: counts.append(c) or kept(c, *a))
    statistics._correlations(spark, "/root/testdata/sf0.001")
    exchanges = [line for line in plan(counts[0]).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]  # both sums of a barcode are made where its line items are


def test_deltas_meet_a_long_list_of_genes_in_dealt_tasks(spark, monkeypatch):
    from cellqtl.plans import views
    from cellqtl.plans.queries import QUERIES

    monkeypatch.setattr(views, "ROWS", 1000)
    assert "Exchange hashpartitioning(gene#" in (p := plan(QUERIES["a9_by_include"](spark, "/root/testdata/sf0.001"))) and p.count("REPARTITION_BY_NUM") == 4


def test_association_computes_its_matrices_once(spark):
    (expr, seen), (dosages, also) = (counting(spark, matrix_of(spark).repartition(3)) for _ in range(2))
    g = dosages.select(F.col("gene").alias("snp"), "sample", (F.col("value") % 3).alias("dosage"))
    gte = spark.range(6).select(F.col("id").alias("genotype_id"), F.col("id").alias("expression_id"), F.lit("x").alias("dataset"))
    place = lambda name, at: spark.range(40).select(F.col("id").alias(name), F.lit(1).alias("chr"), F.col("id").alias(at))
    got = A.cis_association(g, expr, gte, place("gene", "tss"), place("snp", "pos"), maf=0.0, call=0.0, hwe=0.0, min_obs=6)
    assert got.count() == 1600 and (seen.value, also.value) == (240, 240)


def test_known_cells_of_a_vcf_are_read_without_a_row_for_each_absent_one(spark, tmp_path, monkeypatch):
    from cellqtl.plans.queries import QUERIES
    from cellqtl.sources import genome

    rng = np.random.default_rng(2)
    odd = ["0/0", "0|1", "1/1", ".|.", ".", "./1", "1/2", "0/./.", "./.:.", "0/0:5", "./.:5", "1", "", "0/1:0.5:0,1,0"]
    line = lambda i, form: "\t".join(["1", "5", f"v{i}", "A", "G", ".", "PASS", ".", form, *("./." if rng.random() < 0.95 else str(rng.choice(odd)) for _ in range(400))])
    lines = [line(i, form) for i, form in enumerate(["GT", "GT:DS", "DS:GT", "GT:DS:GP", "DS"] * 6)]
    lines += ["\t".join(["1", "5", "none", "A", "G", ".", "PASS", ".", "GT", *["./."] * 400])]
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(400))])
    (tmp_path / "a.vcf").write_text("\n".join(["##x", head, *lines]) + "\n")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(genome.genotypes_long(genome.read_vcf(spark, str(tmp_path))).where("dosage IS NOT NULL"))
    for cells, text in ((64, 1 << 22), (3, 2000), (1, 1)):
        monkeypatch.setattr(genome, "RUN_CELLS", cells)
        monkeypatch.setattr(genome, "TEXT", text)
        assert len(want) > 100 and key(genome.known_genotypes(spark, str(tmp_path))) == want
    # by names alone are rows made, not by calls
    assert plan(QUERIES["s3_read_vcf_all"](spark, "/root/testdata/sf0.001")).count("Generate") == 1
