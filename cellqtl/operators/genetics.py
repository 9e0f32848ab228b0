"""Joins and filters of variants, genotypes, annotation and effects."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import hwe_p, two_sided_p
from ..functions.scalars import correlation, pvalue_to_zscore, zscore_to_beta
from .ranking import same


def extract(df: DataFrame, spec: list[tuple[str, str | dict | None, str]]) -> Column:
    """F1. A value from parts (column, pattern, suffix), one after another. A pattern gives its first group and must match
    at the start; a dict translates (a table does in :func:`join_dictionaries`); None takes the column as it is. A part without a value makes the whole null; absent columns are left
    out; an empty result is null."""
    parts = []
    for column, how, suffix in spec:
        if column not in df.columns:
            continue
        c = F.col(f"`{column}`").cast("string")
        if isinstance(how, dict):
            c = F.element_at(F.create_map(*(F.lit(x) for kv in how.items() for x in kv)), c)
        elif how is not None:
            c = F.when(c.rlike(f"^(?:{how})"), F.regexp_extract(c, f"^(?:{how})", 1))
        parts.append(F.concat(c, F.lit(suffix)))
    return F.nullif(F.concat(*parts), F.lit("")) if parts else F.lit(None).cast("string")


def join_dictionaries(df: DataFrame, specs: dict[str, list]) -> tuple[DataFrame, dict[str, list]]:
    """F1, for dictionaries of any size. A part whose ``how`` is a table (key, value) becomes a column by a left join, and the part names that column. Of a key
    with several values the least counts."""
    out, told = df, {}
    for field, parts in specs.items():
        told[field] = []
        for i, (column, how, suffix) in enumerate(parts):
            if isinstance(how, DataFrame) and column in df.columns:
                name = f"_joined_{field}_{i}"
                words = how.groupBy(F.col("key").cast("string").alias("_key")).agg(F.min(F.col("value").cast("string")).alias(name))
                out = out.join(words, F.col(f"`{column}`").cast("string") == F.col("_key"), "left").drop("_key")
                column, how = name, None
            told[field].append((column, how, suffix))
    return out, told


#: F4. The standard fields, and which of them are numbers and p values.
FIELDS = "gene_symbol gene_id rsid position alleles ea oa beta beta_se n_tests p permuted_p bonferroni z fdr n af mac maf".split()
NUMBERS = "beta beta_se n_tests p permuted_p bonferroni z fdr n af mac maf".split()
WHOLE, P_VALUES = ("n_tests", "n", "mac"), ("p", "permuted_p", "bonferroni", "fdr")


def standardize(df: DataFrame, specs: dict[str, list], numbers: list[str], p_values: list[str]) -> DataFrame:
    """F4. The fields of the specs, numbers cast where they can be. Rows without gene or snp, or with a p value outside of 0 to 1,
    are dropped."""
    df, specs = join_dictionaries(df, specs)
    out = df.select(*(extract(df, s).alias(n) for n, s in specs.items()))
    out = out.withColumns({n: F.col(n).try_cast("double") for n in numbers}).dropna(subset=["gene", "snp"])
    for p in p_values:
        out = out.where(F.col(p).isNull() | F.col(p).between(0, 1))
    return out.withColumn("key", F.concat_ws("_", "gene", "snp"))


def standardize_all(df: DataFrame, specs: dict[str, list], gene: str = "gene_id", snp: str = "position", include_fdr: bool = True) -> DataFrame:
    """F4 with all 19 fields. ``gene`` and ``snp`` name the fields that make the key. Whole numbers are cut toward zero ("180.0" is 180); a
    field that no row has is left out, as is the rate of the replication side (``include_fdr`` False)."""
    names = [f for f in FIELDS if f in specs and (include_fdr or f != "fdr")]
    df, specs = join_dictionaries(df, specs)
    kind = lambda f: "long" if f in WHOLE else "double"
    out = df.select(*((extract(df, specs[f]).try_cast("double").cast(kind(f)) if f in NUMBERS else extract(df, specs[f])).alias(f) for f in names))
    out = out.where(F.col(gene).isNotNull() & F.col(snp).isNotNull())
    for p in (f for f in names if f in P_VALUES):
        out = out.where(F.col(p).isNull() | F.col(p).between(0, 1))
    held = out.agg(*(F.count(f).alias(f) for f in names)).first()  # 19 numbers
    keyed = out.withColumns({"gene": F.col(gene), "snp": F.col(snp), "key": F.concat_ws("_", gene, snp)})
    return keyed.select(*(f for f in names if held[f]), "gene", "snp", "key")


def load_column_specs(text: str) -> tuple[dict[str, list], int | None]:
    """F2. (specs, sample size) of a source declared in JSON: an object of fields, each a column name or a list of [column, pattern or
    dictionary or null, suffix]; "N" may be a number. What is not of that form is an error."""
    declared = json.loads(text)
    if not isinstance(declared, dict):
        raise ValueError("a source is an object of fields")
    specs, size = {}, None
    for field, spec in declared.items():
        if field == "N" and isinstance(spec, int):
            size = spec
            continue
        if field not in FIELDS:
            raise ValueError(f"unknown field {field}")
        if spec is None:
            continue
        parts = [[spec, None, ""]] if isinstance(spec, str) else spec
        for part in parts if isinstance(parts, list) else [None]:
            if not (isinstance(part, list) and len(part) == 3 and isinstance(part[0], str) and (part[1] is None or isinstance(part[1], str | dict)) and (part[2] is None or isinstance(part[2], str))):
                raise ValueError(f"field {field}: a column name or a list of [column, pattern, suffix]")
        specs[field] = [(c, how, suffix or "") for c, how, suffix in parts]
    return specs, size


def translate_genes(df: DataFrame, genes: DataFrame, source: str, target: str, order: str | None = None) -> DataFrame:
    """F5. Names of genes in another naming; of a repeated name the first by ``order`` stays (by the target where that is not given); what
    has none is null. Where the target is the source of the other direction, a repeated one is an error for :func:`unique_ids`."""
    first = genes.groupBy(source).agg(F.min_by(target, F.struct(order or target, target)).alias(target))
    return df.join(first, source, "left")


def unique_ids(genes: DataFrame, column: str) -> DataFrame:
    """F5. ``genes``, of which a repeated identifier is an error."""
    n = genes.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return genes.join(n, column).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated identifier"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def fill_missing_stats(df: DataFrame, infer: bool = True, n: int | None = None) -> DataFrame:
    """F6. Fields that are absent and follow from others, in this order: the other allele, Bonferroni's p, N (``n``, else from MAC and MAF), MAF, z
    (from beta and p, else, where inferring, from beta, MAF and N), the standard error (inferred from z, MAF and N), p from z."""
    has = lambda *c: set(c) <= set(out.columns)
    out = df
    if has("alleles", "ea") and not has("oa"):
        a = F.split("alleles", "/")
        out = out.withColumn("oa", F.when(a[0] == F.col("ea"), F.get(a, F.lit(1))).otherwise(a[0]))
    if has("p", "n_tests") and not has("bonferroni"):
        out = out.withColumn("bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("n_tests")))
    if has("af") and not has("maf"):
        out = out.withColumn("maf", F.least(F.col("af"), 1 - F.col("af")))
    if not has("n") and n is not None:
        out = out.withColumn("n", F.lit(n).cast("long"))
    if has("mac", "maf") and not has("n"):
        out = out.withColumn("n", F.when(F.col("maf") > 0, F.floor(F.col("mac") / F.col("maf") / 2)))
    if has("beta", "p") and not has("z"):
        out = out.withColumn("z", pvalue_to_zscore(F.col("p"), F.col("beta")))
    if infer and has("beta", "maf", "n") and not has("z"):
        # z solves beta = z / sqrt(2 maf (1 - maf) (n + z^2))
        h = 2 * F.col("maf") * (1 - F.col("maf")) * F.col("beta") ** 2
        out = out.withColumn("z", F.when(h < 1, F.signum("beta") * F.sqrt(h * F.col("n") / (1 - h))))
    if infer and has("z", "maf", "n") and not has("beta_se"):
        out = out.withColumn("beta_se", zscore_to_beta(F.col("z"), F.col("maf"), F.col("n"))[1])
    if has("z") and not has("p"):
        out = out.withColumn("p", two_sided_p(F.col("z")))
    return out


def variant_stats(genotypes: DataFrame, by: tuple[str, ...] = ("snp",)) -> DataFrame:
    """A22. Call rate, minor allele frequency and counts of the three genotypes of each variant (of each dataset, if that is in ``by``)."""
    d = F.col("dosage")
    g = genotypes.groupBy(*by).agg(F.count("*").alias("n"), F.count("dosage").alias("called"), *(F.count_if(d == i).alias(f"n{i}") for i in range(3)), F.sum("dosage").alias("_s"))
    af = F.try_divide("_s", 2 * F.col("called"))
    return g.withColumns({"call": F.col("called") / F.col("n"), "maf": F.least(af, 1 - af)}).drop("_s", "called")


def with_hwe(stats: DataFrame) -> DataFrame:
    """A22. The exact Hardy-Weinberg p value of each variant's counts n0, n1, n2; it is computed once for variants of equal counts."""
    counts = ["n0", "n1", "n2"]
    return stats.join(stats.select(*counts).distinct().withColumn("hwe", hwe_p(*counts)), counts)


def filter_variants(stats: DataFrame, least: dict[str, float], variants: DataFrame | None = None, chromosome: str | None = None) -> DataFrame:
    """F12. Variants of which no value (call, maf, hwe, r2) is below its threshold, of those listed and of the chromosome."""
    for column, value in least.items():
        stats = stats.where(~(F.col(column) < value))
    if chromosome is not None:
        stats = stats.where(F.col("chr").cast("string") == chromosome)
    return stats if variants is None else stats.join(variants.select("snp"), "snp", "left_semi")


def filter_genotypes(genotypes: DataFrame, stats: DataFrame, least: dict[str, float], variants: DataFrame | None = None, chromosome: str | None = None, samples: DataFrame | None = None) -> DataFrame:
    """F12 on the genotypes themselves: those of variants that pass :func:`filter_variants` and, with ``samples`` (sample), of the listed samples alone."""
    kept = genotypes.join(filter_variants(stats, least, variants, chromosome).select("snp"), "snp", "left_semi")
    return kept if samples is None else kept.join(samples.select("sample"), "sample", "left_semi")


def select_demultiplex_variants(genotypes: DataFrame, variants: DataFrame, exons: DataFrame, maf: float = 0.05, r2: float = 0.3, width: int = 10_000) -> DataFrame:
    """F18. Variants (snp, chr, pos, ref, alt, r2) for telling donors apart: MAF anew from the genotypes and R2 at least the bounds, two alleles of one
    base each, every sample called, and inside an exon (chr, start, end; start counts from 0). Exons and variants meet in buckets of
    ``width`` bases, so the join is an equality join; in order of chromosome and position. Exons are cut at the buckets' ends, and of the pieces that
    begin or end with a bucket only the longest is kept: two for each bucket, whatever the exons are, and those that lie inside of one. The
    join is by a merge, as the planner cannot see how many pieces the exons make and would send them all through the driver."""
    stats = variant_stats(genotypes).where((F.col("call") == 1) & (F.col("maf") >= maf)).select("snp", F.col("maf"))
    simple = variants.where((F.col("r2") >= r2) & (F.length("ref") == 1) & (F.length("alt") == 1)).join(stats, "snp")
    at, start, end = F.col("_b") * width, F.col("start"), F.col("end")
    e = exons.where(start < end).select("chr", "start", "end", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))).alias("_b"))
    e = e.select("chr", "_b", F.greatest(start, at - 1).alias("_lo"), F.least(end, at + width - 1).alias("_hi"))
    e = e.groupBy("chr", "_b", "_lo").agg(F.max("_hi").alias("_hi")).groupBy("chr", "_b", "_hi").agg(F.min("_lo").alias("_lo")).hint("merge")
    v = simple.withColumn("_b", F.floor(F.col("pos") / width))
    on = [v["chr"] == e["chr"], v["_b"] == e["_b"], v["pos"] > e["_lo"], v["pos"] <= e["_hi"]]
    return v.join(e, on, "left_semi").drop("_b").orderBy("chr", "pos", "snp")


def filter_matrix(long: DataFrame, genes: DataFrame | None = None, samples: DataFrame | None = None, head: int | None = None, tail: int | None = None) -> DataFrame:
    """F13. Cells of the listed genes and samples; of the genes in order the first (``head``) or last (``tail``) ones only."""
    for key, wanted in (("gene", genes), ("sample", samples)):
        if wanted is not None:
            long = long.join(wanted.select(key), key, "left_semi")
    for n, order in ((head, F.asc("gene")), (tail, F.desc("gene"))):
        if n is not None:
            long = long.join(long.select("gene").distinct().orderBy(order).limit(n), "gene", "left_semi")
    return long


def add_snp_positions(effects: DataFrame, positions: DataFrame) -> DataFrame:
    """J5. Chromosome, position and alleles of each effect's variant, where known."""
    return effects.join(positions.select("snp", "chr", "pos", "alleles"), "snp", "left")


def find_snps(wanted: DataFrame, positions: DataFrame) -> DataFrame:
    """J5, reversed. The variants (snp, chr, pos, alleles) at wanted places ``chr:pos``."""
    at = F.split("position", ":")
    w = wanted.select("position", F.regexp_replace(at[0], "^chr", "").alias("chr"), F.get(at, F.lit(1)).try_cast("long").alias("pos"))
    p = positions.select("snp", F.col("chr").cast("string").alias("chr"), F.col("pos").cast("long").alias("pos"), "alleles")
    return w.join(p, ["chr", "pos"], "left")


def assemble_qtl_chunks(results: DataFrame, features: DataFrame, variants: DataFrame, wanted: DataFrame | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """J6. Results with what is known of feature and variant, and the number of tests of the feature. The count is an aggregate
    that is joined back, so that it combines on the map side. With ``wanted`` (gene, snp), those pairs alone, of known variants."""
    n = results.groupBy("gene").agg(F.count("*").alias("n_tests"))
    if wanted is not None:
        results = results.join(wanted.select("gene", "snp").distinct(), ["gene", "snp"], "left_semi")
    out = results.join(n, "gene").join(features, "gene", "left").join(variants, "snp", "left" if wanted is None else "inner")
    return out.withColumnsRenamed(renames or {})


def genotype_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """J10. By sample: variants called in both tables, and those called alike."""
    j = a.select("snp", "sample", F.col("dosage").alias("_a")).join(b.select("snp", "sample", F.col("dosage").alias("_b")), ["snp", "sample"]).where("_a IS NOT NULL AND _b IS NOT NULL")
    return j.groupBy("sample").agg(F.count("*").alias("compared"), F.count_if(F.col("_a") == F.col("_b")).alias("equal"))


def discordant_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """J10. By variant: samples called in both tables, and those called differently."""
    j = a.select("snp", "sample", F.col("dosage").alias("_a")).join(b.select("snp", "sample", F.col("dosage").alias("_b")), ["snp", "sample"]).where("_a IS NOT NULL AND _b IS NOT NULL")
    return j.groupBy("snp").agg(F.count("*").alias("compared"), F.count_if(F.col("_a") != F.col("_b")).alias("discordant"))


def match_variants(variants: DataFrame) -> DataFrame:
    """J10. The key chr:pos:alleles in alphabetic order, by which variants of two tables are the same."""
    return variants.withColumn("variant", F.concat_ws(":", "chr", "pos", F.array_join(F.array_sort(F.split("alleles", "/")), ":")))


def field_concordance(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J10. For each field of both tables: rows compared, whether all are equal, and Pearson's r of those that are numbers on both sides."""
    text = lambda df, s: df.select(F.col(key), *(F.col(f).cast("string").alias(f"{s}{f}") for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("x"), F.col(f"b_{f}").alias("y")) for f in fields))
    j = text(a, "a_").join(text(b, "b_"), key).select(F.inline(each)).where("x IS NOT NULL AND y IS NOT NULL")
    r = correlation(F.col("x").try_cast("double"), F.col("y").try_cast("double"))
    return j.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x") == F.col("y")).alias("all_equal"), r.alias("r"))


def tss_distance(top: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """J12. Distance of a variant to the start of its gene on the same chromosome, with the sign of the direction of transcription; without
    annotation, to the gene's position in ``gene_chr`` and ``gene_pos``."""
    if annotation is None:
        return top.where(F.col("chr") == F.col("gene_chr")).withColumns({"tss": F.col("gene_pos"), "distance": F.col("pos") - F.col("gene_pos")})
    back = F.col("strand") == "-"
    a = annotation.select("gene", "chr", "strand", F.when(back, F.greatest("chr_start", "chr_end")).otherwise(F.least("chr_start", "chr_end")).alias("tss"))
    return top.join(a, ["gene", "chr"]).withColumn("distance", F.when(back, F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))).drop("strand")


def natural_match(top: DataFrame, all_: DataFrame, rounded: dict[str, int]) -> DataFrame:
    """J13. Rows equal in all shared columns, the listed ones after rounding."""
    shared = [c for c in top.columns if c in all_.columns]
    cut = lambda df: df.withColumns({c: F.format_number(c, n) for c, n in rounded.items()})
    return cut(top).join(cut(all_), shared)


def compare_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """J17. Effects of two programs by gene; the second's is turned where its effect allele differs."""
    o = b.select("gene", F.col("ea").alias("_ea"), F.col("beta").alias("beta_b"))
    return a.join(o, "gene").withColumn("beta_b", F.when(F.col("ea") != F.col("_ea"), -F.col("beta_b")).otherwise(F.col("beta_b"))).drop("_ea")


def attach_variant_info(effects: DataFrame, alleles: DataFrame, stats: DataFrame) -> DataFrame:
    """J18. Every effect with other and effect allele and the statistics of its variant, where known once. Statistics with a ``mask``
    count where it is 1."""
    if "mask" in stats.columns:
        stats = stats.where("mask = 1").drop("mask")
    info = alleles.join(stats, "snp", "left").distinct()
    once = info.groupBy("snp").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    a = F.split("alleles", "/")
    return effects.join(info.join(once, "snp").withColumns({"oa": a[0], "ea": F.get(a, F.lit(1))}).drop("alleles"), "snp", "left")


def meta_analyse_p(effects: DataFrame, min_datasets: int = 2) -> DataFrame:
    """H20 with the p value of the combined z."""
    return meta_analyse(effects, min_datasets).withColumn("p", two_sided_p(F.col("z")))


def meta_analyse(effects: DataFrame, min_datasets: int = 2) -> DataFrame:
    """H20. z scores of several datasets, weighted by the roots of their sizes."""
    g = effects.groupBy("gene", "snp").agg(F.count("*").alias("n_datasets"), F.sum("n").alias("n"), F.sum(F.sqrt("n") * F.col("z")).alias("_s"))
    return g.where(F.col("n_datasets") >= min_datasets).withColumn("z", F.col("_s") / F.sqrt("n")).drop("_s")


def merge_top_effects(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """W6. One row per gene of all chunks, in the order of a p value column if given; a gene whose rows differ is an error."""
    rest = [c for c in chunks.columns if c != "gene"]
    g = chunks.distinct().groupBy("gene").agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    out = g.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("rows of a gene differ"))).otherwise(F.col("_n"))).where("_n = 1").select("gene", "_r.*")
    return out.orderBy(order, "gene") if order else out


def rb_by(df: DataFrame, by: list[str], theta: float = 0.0) -> DataFrame:
    """H3. by, n, rb, se, p: correlation of true effects b1 and b2 with standard errors se1 and se2 in each group, its standard error by
    leaving out each row, and the p value of its chi-squared with one degree of freedom. Sums of each group are joined to its
    rows, so leaving out a row is a subtraction. Null with fewer than three rows or a column that does not vary."""
    x = df.select(*by, *(F.col(c).cast("double").alias(c) for c in ("b1", "se1", "b2", "se2"))).dropna(subset=["b1", "se1", "b2", "se2"])
    terms = {"a": F.col("b1"), "b": F.col("b2"), "aa": F.col("b1") ** 2, "bb": F.col("b2") ** 2, "ab": F.col("b1") * F.col("b2"), "u": F.col("se1") ** 2, "v": F.col("se2") ** 2}
    rows = x.select(*by, *(e.alias(k) for k, e in terms.items()))
    varies = [F.min(c) < F.max(c) for c in ("b1", "se1", "b2", "se2")]
    sums = x.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"), *(F.sum(e).alias(f"_{k}") for k, e in terms.items()), (varies[0] & varies[1] & varies[2] & varies[3]).alias("_varies"))

    def estimate(n: Column, v) -> Column:
        cov = (v("ab") - v("a") * v("b") / n) / (n - 1)
        va, vb = (v("aa") - v("a") * v("a") / n) / (n - 1), (v("bb") - v("b") * v("b") / n) / (n - 1)
        u, w = v("u") / n, v("v") / n
        inner = (va - u) * (vb - w)
        return F.try_divide(cov - theta * F.sqrt(u * w), F.sqrt(F.when((va > u) & (vb > w), inner).otherwise(va * vb)))

    held = lambda r: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    n = F.col("_n")
    left_out = same(rows, sums, by).where("_n >= 3").withColumn("_r", held(estimate(n - 1, lambda k: F.col(f"_{k}") - F.col(k))))
    spread = left_out.groupBy(*by).agg(F.sqrt((F.first("_n") - 1) * F.var_pop("_r")).alias("se"))
    ok = (n >= 3) & F.col("_varies")
    out = same(sums, spread, by, "left").select(*by, n.cast("long").alias("n"), F.when(ok, held(estimate(n, lambda k: F.col(f"_{k}")))).alias("rb"), F.when(ok, F.col("se")).alias("se"))
    return out.withColumn("p", two_sided_p(F.try_divide("rb", "se")))


def rb(df: DataFrame, theta: float = 0.0) -> DataFrame:
    """H3 over all rows."""
    return rb_by(df, [], theta)
