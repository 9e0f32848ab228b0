"""Joins, tallies and unions of cell, donor and sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import ranked, same

#: Names up to which those of several studies are sent to all tasks; more are joined.
BROADCAST_NAMES = 1_000_000


def build_cell_metadata(cells: DataFrame, droplets: DataFrame, cell_types: DataFrame, donors: DataFrame, pairing: DataFrame | None = None) -> DataFrame:
    """J1. Cells with a droplet call (inner; the dataset is part of the key where both have it), their cell type, their donor (of the same dataset where
    both have it) and what is paired with their sample (left). A repeated barcode is an error."""
    both = lambda a, b, keys: [k for k in keys if k in a.columns and k in b.columns]
    m = cells.join(droplets, both(cells, droplets, ["barcode", "pool", "dataset"])).join(cell_types, "barcode", "left")
    m = m.join(donors, both(m, donors, ["sample", "dataset"]), "left")
    if pairing is not None:
        m = m.join(pairing, both(m, pairing, ["sample", "dataset"]), "left")
    repeated = m.groupBy("barcode").agg(F.count(F.lit(1)).alias("_n"))
    return m.join(repeated, "barcode").withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated barcode"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def assignment_key(metadata: DataFrame, lane: str = "pool") -> DataFrame:
    """J1. The name ``sample;;lane`` of a donor in one run."""
    return metadata.withColumn("assignment_run_lane", F.concat_ws(";;", "sample", lane))


def attach_barcode_qc(metadata: DataFrame, qc: DataFrame) -> DataFrame:
    """J2. Cells that have quality metrics."""
    return metadata.join(qc, "barcode")


def sample_overlap(sets: dict[str, DataFrame], key: str = "sample") -> DataFrame:
    """J11. For every sample, which sets hold it: one boolean column per set."""
    tagged = [df.select(key, F.lit(name).alias("_s")) for name, df in sets.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*(F.bool_or(F.col("_s") == n).alias(f"in_{n}") for n in sets))


def overlap_sizes(sets: dict[str, DataFrame], key: str = "sample") -> DataFrame:
    """J11. Size of each set and of every intersection: one row per combination of sets, with the samples that all of them hold."""
    held = sample_overlap(sets, key)
    names = list(sets)
    groups = [[n for i, n in enumerate(names) if k >> i & 1] for k in range(1, 1 << len(names))]
    each = [F.struct(F.lit("+".join(g)).alias("sets"), F.count_if(reduce(Column.__and__, (F.col(f"in_{n}") for n in g))).alias("n")) for g in groups]
    return held.agg(F.array(*each).alias("_s")).select(F.inline("_s"))


def barcode_sources(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """J14. All barcodes of two lists with a flag for each list."""
    return sample_overlap({names[0]: a, names[1]: b}, key)


def rekey_metadata(barcodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """J15. Metadata of another tool's barcodes; what is missing is ``NA``."""
    text = [F.col(c).cast("string").alias(c) for c in metadata.columns if c != "barcode"]
    return barcodes.select("barcode").join(metadata.select("barcode", *text), "barcode", "left").fillna("NA", [c for c in metadata.columns if c != "barcode"])


def demux_match_rate(ref: DataFrame, alt: DataFrame, unassigned: str) -> DataFrame:
    """J16. By pool: cells in both tables, those with a call, those whose call is the reference's, and percentages."""
    j = ref.select("barcode", "pool", F.col("call").alias("_r")).join(alt.select("barcode", F.col("call").alias("_a")), "barcode")
    out = j.groupBy("pool").agg(F.count("*").alias("total"), F.count_if(F.col("_a") != unassigned).alias("assigned"), F.count_if(F.col("_a") == F.col("_r")).alias("matched"))
    return out.withColumns({"pct_total": 100 * F.col("matched") / F.col("total"), "pct_assigned": F.try_divide(100 * F.col("matched"), F.col("assigned"))})


def demux_match_by_method(ref: DataFrame, calls: DataFrame, unassigned: str) -> DataFrame:
    """J16. The same by method and pool, with the rows of each method over all pools (null pool). ``calls`` has barcode, method, call."""
    j = ref.select("barcode", "pool", F.col("call").alias("_r")).join(calls.select("barcode", "method", F.col("call").alias("_a")), "barcode")
    g = j.groupingSets([[F.col("method")], [F.col("method"), F.col("pool")]], "method", "pool")
    out = g.agg(F.count("*").alias("total"), F.count_if(F.col("_a") != unassigned).alias("assigned"), F.count_if(F.col("_a") == F.col("_r")).alias("matched"))
    return out.withColumns({"pct_total": 100 * F.col("matched") / F.col("total"), "pct_assigned": F.try_divide(100 * F.col("matched"), F.col("assigned"))})


def consensus_droplet_type(df: DataFrame, a: str, b: str) -> DataFrame:
    """F21. A singlet is one for both tools."""
    return df.withColumn("droplet", F.when((F.col(a) == "singlet") & (F.col(b) == "singlet"), "singlet").otherwise("doublet"))


def merge_pools(expr: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """A4. Sums over pools."""
    return expr.groupBy(*by).agg(*(F.sum(v).alias(v) for v in values))


def settings_grid(stats: DataFrame, settings: list[str], datasets: list) -> DataFrame:
    """A7. Cells per combination of settings: one column per dataset, and their total."""
    wide = stats.groupBy(*settings).pivot("dataset", datasets).agg(F.sum("n_cells"))
    return wide.withColumn("total", reduce(Column.__add__, (F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in datasets)))


def genes_grid(stats: DataFrame, settings: list[str], steps: list[str]) -> DataFrame:
    """A7. Genes left after each filter step (filter, n_genes) for every combination of settings, one column per step."""
    return stats.groupBy(*settings).pivot("filter", steps).agg(F.sum("n_genes"))


def pipeline_overview(stats: DataFrame, genes: DataFrame, links: DataFrame, steps: dict[str, str]) -> DataFrame:
    """A17. By cell type and dataset, and over all datasets (null): samples and cells, those that are PCA outliers and those kept, and the genes left
    after each filter. ``stats`` has cell_type, dataset, sample, n_cells; ``genes`` cell_type, filter, n_genes; ``links`` cell_type, sample,
    include; ``steps`` names the filters' columns."""
    j = stats.join(links.select("cell_type", "sample", "include"), ["cell_type", "sample"], "left")
    kept, gone, cells = F.col("include"), ~F.col("include"), F.col("n_cells")
    each = [F.count(F.lit(1)).alias("n_samples"), F.sum(cells).alias("n_cells"), F.count_if(gone).alias("n_outliers"), F.coalesce(F.sum(F.when(gone, cells)), F.lit(0)).alias("cells_removed")]
    each += [F.count_if(kept).alias("n_kept"), F.coalesce(F.sum(F.when(kept, cells)), F.lit(0)).alias("cells_kept")]
    g = j.groupingSets([[F.col("cell_type")], [F.col("cell_type"), F.col("dataset")]], "cell_type", "dataset").agg(*each)
    wide = genes.groupBy("cell_type").agg(*(F.sum(F.when(F.col("filter") == k, F.col("n_genes"))).alias(v) for k, v in steps.items()))
    return g.join(wide, "cell_type", "left")


def confusion_all_columns(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A11. For every shared column, how often a label of one table meets a label of the other, as shares of both."""
    long = lambda df, v: df.select(*keys, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(keys, columns, "column", v)
    n = long(a, "label_a").join(long(b, "label_b"), [*keys, "column"]).groupBy("column", "label_a", "label_b").agg(F.count("*").alias("n"))
    share = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy("column", c))
    return n.withColumns({"of_a": share("label_a"), "of_b": share("label_b")})


def cell_filter_funnel(cells: DataFrame, steps: dict[str, Column], by: list[str]) -> DataFrame:
    """A14. Cells left after each step, all steps before it included, in one pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("input")]
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return cells.groupBy(*by).agg(*aggs)


def threshold_grid(cells: DataFrame, steps: dict[str, Column | tuple[Column, str, list[float]]], by: list[str]) -> DataFrame:
    """A14 for every combination of thresholds. A step is a condition, or a value, ``min`` or ``max``, and its thresholds (a value equal to one passes; null
    never does). by, at_<step> for each step with thresholds, input and the cells left after each step, the steps before it included.

    Each cell is reduced to how many thresholds of each step it passes, loosest first; these combinations are counted in one pass, and what
    passes a combination of thresholds is a sum over that small table."""
    levels, grids = {}, {}
    for name, step in steps.items():
        if isinstance(step, tuple):
            value, kind, at = step
            grids[name] = sorted(set(at), reverse=kind == "max")
            passes = [F.coalesce((value >= t) if kind == "min" else (value <= t), F.lit(False)) for t in grids[name]]
        else:
            passes = [F.coalesce(step, F.lit(False))]
        levels[name] = reduce(Column.__add__, (p.cast("int") for p in passes))
    counted = cells.select(*by, *(c.alias(f"_l_{n}") for n, c in levels.items())).groupBy(*by, *(f"_l_{n}" for n in levels)).agg(F.count(F.lit(1)).alias("_n"))
    out = counted
    for n, at in grids.items():
        out = out.withColumn(f"_g_{n}", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(at)))))
    passed, aggs = F.lit(True), [F.sum("_n").alias("input")]
    for n in levels:
        passed = passed & (F.col(f"_l_{n}") >= (F.col(f"_g_{n}.i") if n in grids else F.lit(1)))
        aggs.append(F.sum(F.when(passed, F.col("_n")).otherwise(0)).alias(n))
    return out.groupBy(*by, *(F.col(f"_g_{n}.t").alias(f"at_{n}") for n in grids)).agg(*aggs)


def qtl_results_overview(top: DataFrame, by: list[str], p_columns: list[str], alpha: float) -> DataFrame:
    """A16. By run: genes, single-nucleotide variants, mean N, and the genes below alpha for each p column."""
    below = (F.count_if(F.col(p).cast("string").try_cast("double") < alpha).alias(f"n_{p}") for p in p_columns)
    return top.groupBy(*by).agg(F.count_distinct("gene").alias("n_genes"), F.count_if(F.length("alleles") == 3).alias("n_snps"), F.round(F.avg("n"), 1).alias("mean_n"), *below)


def qtl_overview_full(top: DataFrame, by: list[str], p_columns: list[str], alpha: float, z_alpha: float) -> DataFrame:
    """A16 with the sum of tested variants, the number of groups, and for each dataset of the map ``zs`` the genes whose absolute z is at least
    z_alpha. A p column in which nothing is a number has null."""
    number = lambda p: F.col(p).cast("string").try_cast("double")
    below = [F.when(F.count(number(p)) > 0, F.count_if(number(p) < alpha)).alias(f"n_{p}") for p in p_columns]
    out = top.groupBy(*by).agg(
        F.count_distinct("group").alias("n_groups"), F.count_distinct("gene").alias("n_genes"), F.sum("n_tested").alias("n_tested"), F.count_if(F.length("alleles") == 3).alias("n_snps"), F.round(F.avg("n"), 1).alias("mean_n"), *below
    )
    each = top.select(*by, F.explode("zs").alias("dataset", "_z")).groupBy(*by, "dataset").agg(F.count_if(F.abs("_z") >= z_alpha).alias("k"))
    zs = each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "k")))).alias("n_z"))
    return out.join(zs, by, "left")


def average_read_count(weights: DataFrame) -> DataFrame:
    """A18. Mean weight over all cells of all files."""
    return weights.agg(F.avg("weight").alias("average"))


def samples_per_celltype(cells: DataFrame) -> DataFrame:
    """A24. By cell type: donors and cells of ``cells``, which the caller has filtered (see :func:`cells.passing_cells`)."""
    return cells.groupBy("cell_type").agg(F.count_distinct("sample").alias("n_samples"), F.count("*").alias("n_cells"))


def matrix_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """A25. Over shared cells and shared genes, non-zero entries of either: their number and the share that is equal."""
    shared = {k: a.select(k).distinct().join(b.select(k).distinct(), k, "left_semi") for k in ("barcode", "gene")}
    cut = lambda df, v: df.join(shared["barcode"], "barcode", "left_semi").join(shared["gene"], "gene", "left_semi").select("barcode", "gene", F.col("cnt").alias(v))
    j = cut(a, "x").join(cut(b, "y"), ["barcode", "gene"], "full").fillna(0, ["x", "y"])
    return j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("identical"))


def differing_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """A25. The entries of shared cells and genes that are not equal, with both values."""
    shared = {k: a.select(k).distinct().join(b.select(k).distinct(), k, "left_semi") for k in ("barcode", "gene")}
    cut = lambda df, v: df.join(shared["barcode"], "barcode", "left_semi").join(shared["gene"], "gene", "left_semi").select("barcode", "gene", F.col("cnt").alias(v))
    return cut(a, "x").join(cut(b, "y"), ["barcode", "gene"], "full").fillna(0, ["x", "y"]).where("x <> y")


def kept_share(tally: DataFrame, kept: DataFrame) -> DataFrame:
    """A23. By chromosome and over all (null): rejected, kept and the percentage kept. ``tally`` is A23's, in which a variant may have several
    reasons, so rejected ones come from ``kept`` (chr, rejected, kept) where that counts them."""
    g = kept.rollup("chr").agg(F.sum("rejected").alias("rejected"), F.sum("kept").alias("kept"))
    reasons = tally.groupBy("chr").agg(F.count(F.lit(1)).alias("n_reasons"))
    return same(g, reasons, ["chr"], "left").withColumn("pct_kept", F.try_divide(100.0 * F.col("kept"), F.col("kept") + F.col("rejected")))


def filter_log_tally(log: DataFrame, cr: float, maf: float, hwe: float) -> DataFrame:
    """A23. Rejected variants by reason; the pre-filter's are told apart by the values in ``CR=..;MAF=..;HWE=..``
    (an HWE of -1 is not a value)."""
    v = lambda k: F.nullif(F.regexp_extract("values", rf"(?:^|;){k}=([^;]*)", 1), F.lit("")).try_cast("double")
    parts = F.array_compact(F.array(F.when(v("CR") <= cr, "CR"), F.when(v("MAF") <= maf, "MAF"), F.when((v("HWE") != -1) & (v("HWE") <= hwe), "HWE")))
    reasons = F.when(F.col("reason") == "prefilter", parts).otherwise(F.array("reason"))
    return log.select("chr", F.explode(reasons).alias("reason")).rollup("reason", "chr").agg(F.count("*").alias("n")).where("reason IS NOT NULL")


def gene_batches(genes: DataFrame, n: int) -> DataFrame:
    """W7, without groups. Batches of n genes in the order of chromosome (numbers first), start and gene, ranked by ranges."""
    number = F.col("chr").cast("string").try_cast("int")
    r = ranked(genes, [], [number.isNull(), number, F.col("chr").cast("string"), F.col("chr_start"), F.col("gene")])
    return r.withColumn("batch", F.floor((F.col("_rank") - 1) / n)).select(*genes.columns, "batch")


def grouped_batches(genes: DataFrame, n: int, overflow: int) -> DataFrame:
    """W7 with groups. group, batch of ``genes`` (gene, group, chr, chr_start). Groups lie in the order of their first gene (numeric chromosomes, then others;
    start; gene), then of their name. Whole groups go into a batch until it has n genes; one that would make it larger than n + overflow
    opens the next, and a batch may hold several chromosomes.

    A batch that begins at a group ends at a place that follows from sums of genes alone, so every group first gets the next
    batch's first group as if it began one: a frame of the next n + overflow genes, over pieces of the order that overlap by as many
    groups. The beginnings that are reached from the first group are then marked by pointers of doubled length."""
    number = F.col("chr").cast("string").try_cast("int")
    place = F.struct(number.isNull().alias("t"), number.alias("n"), F.col("chr").cast("string").alias("c"), F.col("chr_start").alias("s"), F.col("gene").alias("g"))
    groups = genes.groupBy("group").agg(F.min(place).alias("_p"), F.count(F.lit(1)).alias("_k"))
    keys = [F.col(f"_p.{c}") for c in "tncs"]
    r = ranked(groups, [], [*keys, F.col("group")])
    parts = r.groupBy("_part").agg(F.sum("_k").alias("_in"))
    parts = parts.select("_part", (F.sum("_in").over(Window.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_in")).alias("_base"))  # a row for each range
    inside = F.sum("_k").over(Window.partitionBy("_part").orderBy("_rank")) - F.col("_k")
    rows = written(r.withColumn("_in", inside).join(F.broadcast(parts), "_part").select("group", (F.col("_rank") - 1).alias("_at"), (F.col("_base") + F.col("_in")).alias("_sum"), "_k"), "groups")
    end = rows.agg(F.count(F.lit(1)).alias("_at"), F.coalesce(F.sum("_k"), F.lit(0)).alias("_sum")).select(F.lit(None).cast(rows.schema["group"].dataType).alias("group"), "_at", "_sum", F.lit(0).cast("long").alias("_k"))
    halo = n + overflow + 1
    piece = F.floor(F.col("_at") / halo)
    pieces = rows.unionByName(end).withColumn("_piece", F.explode(F.array_compact(F.array(piece, F.when(piece > 0, piece - 1)))))
    w = Window.partitionBy("_piece").orderBy("_sum")
    full, most = (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, k)) for k in (n - 1, n + overflow))
    ahead = pieces.withColumns({"_full": full, "_most": most}).where((piece == F.col("_piece")) & F.col("group").isNotNull())
    ahead = ahead.select(F.col("_at").alias("_from"), (F.col("_at") + F.least("_full", F.greatest(F.col("_most") - 1, F.lit(1)))).alias("_to"))
    jumps = [written(ahead, "jumps")]
    while (twice := jumps[-1].alias("a").join(jumps[-1].alias("b"), F.col("a._to") == F.col("b._from")).select(F.col("a._from").alias("_from"), F.col("b._to").alias("_to"))).where("_from = 0").limit(1).count():
        jumps.append(written(twice, "jumps"))
    begun = rows.sparkSession.createDataFrame([(0,)], "_from long")
    for jump in reversed(jumps):
        begun = written(begun.union(begun.join(jump, "_from").select(F.col("_to").alias("_from"))).distinct(), "begun")
    firsts = begun.join(jumps[0], "_from")
    numbered = ranked(firsts, [], [F.col("_from")]).select((F.col("_rank") - 1).alias("batch"), F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_at"))
    return rows.join(numbered, "_at").select("group", "batch")


def exclude_duplicate_donors(stats: DataFrame, excluded: DataFrame) -> DataFrame:
    """W8. Samples to leave out: those listed already, and of a donor in several datasets all but the one with most cells."""
    left = stats.join(excluded.select("sample", "dataset"), ["sample", "dataset"], "left_anti")
    w = Window.partitionBy("sample").orderBy(F.desc("n_cells"), "dataset")
    return left.withColumn("_r", F.row_number().over(w)).where("_r > 1").select("sample", "dataset").unionByName(excluded.select("sample", "dataset")).distinct()


def combine_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """U1. Tables one below another with their dataset; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("dataset", F.lit(n)) for n, df in tables.items()))


def combine_expression(matrices: list[DataFrame], n_samples: int) -> DataFrame:
    """U2. Samples side by side; only genes with a value in every sample stay."""
    all_ = reduce(DataFrame.unionByName, matrices).where("value IS NOT NULL")
    full = all_.groupBy("gene").agg(F.count_distinct("sample").alias("_n")).where(F.col("_n") == n_samples)
    return all_.join(full, "gene", "left_semi")


def merge_covariates(matrices: list[DataFrame]) -> DataFrame:
    """U3. Covariates stacked; samples that miss one go."""
    all_ = reduce(DataFrame.unionByName, matrices).where("value IS NOT NULL")
    n = all_.select("covariate").distinct().agg(F.count("*").alias("_all"))
    full = all_.groupBy("sample").agg(F.count_distinct("covariate").alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all"))
    return all_.join(full, "sample", "left_semi")


def join_corrected(matrices: list[DataFrame]) -> DataFrame:
    """U3, the other axis. Matrices of corrected values (gene, sample, value) of several datasets side by side: genes that all have; a sample in two of them is
    an error."""
    tagged = reduce(DataFrame.unionByName, (m.withColumn("_of", F.lit(i)) for i, m in enumerate(matrices)))
    seen = tagged.groupBy("sample").agg(F.count_distinct("_of").alias("_k"))
    full = tagged.groupBy("gene").agg(F.count_distinct("_of").alias("_n")).where(F.col("_n") == len(matrices))
    out = tagged.join(full, "gene", "left_semi").join(seen, "sample")
    return out.withColumn("_k", F.when(F.col("_k") > 1, F.raise_error(F.lit("sample in two matrices"))).otherwise(F.col("_k"))).where("_k = 1").drop("_k", "_of")


#: Samples of a block of names.
SAMPLES = 1024


def densify_genotypes(merged: DataFrame) -> DataFrame:
    """U4, for an export. A row for every variant and sample, ./. where no study has one. Samples are numbered in blocks of ``SAMPLES`` names; what a variant has in a
    block are numbers, and the block's other names follow from them, so cells that no study has are neither shuffled nor looked up. A block is one task's; no
    row holds a whole header or a whole variant; the result has as many cells as the file."""
    merged = written(merged, "genotypes")
    names = merged.where("sample IS NOT NULL").select("sample").distinct()
    blocks = max(1, -(-names.count() // SAMPLES))
    block = F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int").alias("_b")
    header = written(names.groupBy(block).agg(F.collect_list("sample").alias("_all")), "header")  # the order of its names is the numbers'
    known = merged.where("snp IS NOT NULL AND sample IS NOT NULL")
    number = known.join(header.select("_b", F.posexplode("_all").alias("_i", "sample")).hint("merge"), "sample").select("snp", "_b", "_i")
    each = merged.select("snp").distinct().select("snp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.lit(None).cast("int").alias("_i"))
    held = each.union(number).repartition(blocks, "_b").groupBy("_b", "snp").agg(F.collect_list("_i").alias("_has"))
    # what is absent lies between a number and the next one
    has, end = F.array_sort("_has"), F.size("_all")
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), has).alias("_from"), F.concat(has, F.array(end)).alias("_to"))
    gaps = held.join(header, "_b").select("snp", "_all", F.inline(gaps)).where("_to - _from > 1")
    absent = gaps.select("snp", "_all", F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)).alias("_i"))
    absent = absent.select("snp", F.get("_all", "_i").alias("sample"), F.lit(None).cast("double").alias("dosage"), F.lit("./.").alias("gt"))
    gt = F.when(F.col("dosage").isNull(), "./.").otherwise(F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.col("dosage").cast("int") + 1))
    return known.select("snp", "sample", F.col("dosage").cast("double").alias("dosage"), gt.alias("gt")).union(absent)


def merge_genotypes(studies: dict[str, DataFrame]) -> DataFrame:
    """U4. Genotypes of several studies; a sample name in more than one study gets the study in front. The names in several are counted first; up to
    ``BROADCAST_NAMES`` of them go to all tasks, so that no genotype is shuffled."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("study", F.lit(n)) for n, df in studies.items())).where(F.col("sample").isNotNull())
    names = rows.select("sample", "study").distinct().groupBy("sample").agg(F.count("*").alias("_n")).where("_n > 1")
    names = written(names, "names")
    j = rows.join(F.broadcast(names) if names.count() <= BROADCAST_NAMES else names, "sample", "left")
    return j.withColumn("sample", F.when(F.col("_n") > 1, F.concat_ws("_", "study", "sample")).otherwise(F.col("sample").cast("string"))).drop("_n", "study")


def dataset_covariate(gte: DataFrame) -> DataFrame:
    """U5. The dataset of each expression id as a covariate."""
    return gte.select(F.col("expression_id").alias("sample"), F.lit("dataset").alias("covariate"), F.col("dataset").alias("value"))
