"""Nominal association of expression with genotypes near a gene, by small matrices that meet in buckets of the genome."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import correlation_p
from ..functions.scalars import normal_quantile
from ..sources.scratch import written
from .expression import ROUNDING
from .genetics import variant_stats, with_hwe
from .order import average_ranks

#: Genes and variants of a block where every sample has its cell, and cells of a block's either side. Where few have, a pair seldom has
#: samples enough to be told, and blocks hold more rows.
GENES, VARIANTS, CELLS = 1024, 1024, 2_000_000
#: Pairs, cells of a side and pairs of cells that a task works on at once, and the products of dense cells that cost what one pair of cells costs.
TILE, SIDE, MEET, DENSE = 1_000_000, 4_000_000, 2_000_000, 60


def sample_numbers(gte: DataFrame) -> DataFrame:
    """``gte`` (genotype_id, expression_id, dataset) without repeats, with _k: 0, 1, ... in each dataset."""
    at = F.row_number().over(Window.partitionBy("dataset").orderBy("genotype_id", "expression_id")) - 1  # a row for each sample
    return gte.dropna(subset=["genotype_id", "expression_id", "dataset"]).distinct().withColumn("_k", at)


def normal_expression(expr: DataFrame, links: DataFrame) -> DataFrame:
    """dataset, gene, k, y: sample numbers and normal quantiles of the average ranks of a gene's values in a dataset."""
    e = expr.where(F.col("value").isNotNull()).select("gene", F.col("sample").alias("expression_id"), "value").join(links.select("expression_id", "dataset", "_k"), "expression_id")
    r = average_ranks(e, "value", ["dataset", "gene"])
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset", "gene"))  # a row for each sample
    z = r.select("dataset", "gene", "_k", normal_quantile(F.col("rank") / (n + 1)).alias("y"))
    g = z.groupBy("dataset", "gene").agg(F.collect_list(F.struct("_k", "y")).alias("_e"))
    return g.select("dataset", "gene", F.col("_e._k").alias("k"), F.col("_e.y").alias("y"))


def tested_genotypes(genotypes: DataFrame, links: DataFrame, maf: float, call: float, hwe: float) -> DataFrame:
    """dataset, snp, k, g: sample numbers and dosages of the variants that pass in a dataset: of its own samples' rows neither the allele frequency, nor the
    share that is called, nor the exact Hardy-Weinberg p is below its bound."""
    d = genotypes.select("snp", F.col("sample").alias("genotype_id"), "dosage").join(links.select("genotype_id", "dataset", "_k"), "genotype_id")
    d = written(d, "dosages")
    stats = with_hwe(variant_stats(d, ("dataset", "snp")))
    kept = stats.where(~(F.col("maf") < maf) & ~(F.col("call") < call) & ~(F.col("hwe") < hwe)).select("dataset", "snp")
    g = d.where(F.col("dosage").isNotNull()).groupBy("dataset", "snp").agg(F.collect_list(F.struct("_k", F.col("dosage").cast("double").alias("g"))).alias("_e"))
    return g.join(kept, ["dataset", "snp"]).select("dataset", "snp", F.col("_e._k").alias("k"), F.col("_e.g").alias("g"))


def _cells(table: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sample number and value about its row's mean of each cell."""
    k, v = (pa.concat_arrays(table.column(c).chunks) for c in ("k", value))
    n = np.diff(k.offsets.to_numpy())
    row, v = np.repeat(np.arange(len(n)), n), v.flatten().to_numpy().astype(float)
    return row, k.flatten().to_numpy(), v - (np.bincount(row, v, len(n)) / np.maximum(n, 1))[row]


def _tiles(row: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cells (sorted by row) from and to, whole rows of which ``size`` of the cells adds up to about ``most``."""
    ends = np.append(np.nonzero(np.diff(row))[0] + 1, len(row)) if len(row) else np.zeros(0, int)
    part = np.cumsum(size)[ends - 1] // most if len(row) else ends
    cuts = [0, *ends[np.nonzero(np.diff(part))[0]].tolist(), len(row)]
    return [(i, j) for i, j in zip(cuts, cuts[1:]) if i < j]


def _sparse_sums(left: tuple, right: tuple, n_right: int):
    """Pairs of rows that share samples, and their sums (n, sy, sx, syy, sxx, sxy): each cell meets those of its sample on the other side."""
    (i, ki, y), (j, kj, x) = left, right
    order = np.argsort(kj, kind="stable")
    j, kj, x = j[order], kj[order], x[order]
    first, last = np.searchsorted(kj, ki), np.searchsorted(kj, ki, "right")
    for a, b in _tiles(i, last - first, MEET):
        n = (last - first)[a:b]
        at = np.repeat(np.arange(a, b), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first[a:b], n)
        pairs, of = np.unique(i[at] * n_right + j[other], return_inverse=True)
        u, v = y[at], x[other]
        yield pairs // n_right, pairs % n_right, *(np.bincount(of, w, len(pairs)) for w in (None, u, v, u * u, v * v, u * v))


def _dense_sums(left: tuple, right: tuple, n_left: int, n_right: int):
    """The same as products of dense matrices, tile by tile, over some samples at a time."""
    (i, ki, y), (j, kj, x) = left, right
    samples, at = np.unique(np.concatenate([ki, kj]), return_inverse=True)
    ki, kj = at[: len(ki)], at[len(ki) :]
    rows = max(1, TILE // n_right)
    for top in range(0, n_left, rows):
        height = min(rows, n_left - top)
        total, width = np.zeros((6, height, n_right)), max(1, SIDE // (height + n_right))
        for start in range(0, len(samples), width):
            w = min(width, len(samples) - start)
            p, tp, q, tq = np.zeros((height, w)), np.zeros((height, w)), np.zeros((n_right, w)), np.zeros((n_right, w))
            a = (i >= top) & (i < top + height) & (ki >= start) & (ki < start + w)
            b = (kj >= start) & (kj < start + w)
            p[i[a] - top, ki[a] - start], tp[i[a] - top, ki[a] - start] = y[a], 1
            q[j[b], kj[b] - start], tq[j[b], kj[b] - start] = x[b], 1
            total += np.stack([tp @ tq.T, p @ tq.T, tp @ q.T, (p * p) @ tq.T, tp @ (q * q).T, p @ q.T])
        one, other = np.nonzero(total[0] > 0)
        yield one + top, other, *(m[one, other] for m in total)


def _correlated(genes: pa.Table, variants: pa.Table, window: int, min_obs: int) -> tuple[np.ndarray, ...]:
    """Rows of genes and variants within the window, common samples, r (nan where a side does not vary)."""
    left, right = _cells(genes, "y"), _cells(variants, "g")
    both = np.intersect1d(left[1], right[1])
    left, right = (tuple(c[np.isin(side[1], both)] for c in side) for side in (left, right))
    meet = int((np.bincount(left[1]) * np.bincount(right[1])).sum()) if len(both) else 0
    tss, pos, out = genes.column("tss").to_numpy(), variants.column("pos").to_numpy(), [(np.zeros(0, int),) * 2 + (np.zeros(0),) * 2]
    few = meet * DENSE < genes.num_rows * variants.num_rows * len(both)
    for i, j, n, sy, sx, syy, sxx, sxy in _sparse_sums(left, right, variants.num_rows) if few else _dense_sums(left, right, genes.num_rows, variants.num_rows):
        told = (n >= min_obs) & (np.abs(pos[j] - tss[i]) <= window)
        i, j, n, sy, sx, syy, sxx, sxy = (c[told] for c in (i, j, n, sy, sx, syy, sxx, sxy))
        vy, vx = syy - sy * sy / n, sxx - sx * sx / n
        with np.errstate(all="ignore"):
            r = (sxy - sy * sx / n) / np.sqrt(vy * vx)
        r[~((vy > 1e-12) & (vx > 1e-12))] = np.nan
        # p and z of a correlation of one must not hang on its last bits
        out.append((i, j, n, np.where(np.abs(r) > 1 - ROUNDING, np.sign(r), r)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cis_association(
    genotypes: DataFrame, expr: DataFrame, gte: DataFrame, genes: DataFrame, variants: DataFrame, window: int = 1_000_000,
    maf: float = 0.01, call: float = 0.95, hwe: float = 1e-4, min_obs: int = 10,
) -> DataFrame:
    """H19. dataset, gene, snp, distance, n, r, p, z of every gene (gene, chr, tss) and variant (snp, chr, pos) of one chromosome within the window,
    in each dataset of ``gte``: correlation of the gene's rank-normalised expression (gene, sample, value) with the dosage (snp, sample, dosage) over
    the samples that have both, min_obs or more. Genes and variants are one array each; they meet in buckets of the window's width, cut
    further by a hash where a bucket holds more than a block: CELLS a side, and GENES by VARIANTS, or more of them where pairs seldom share
    min_obs samples. So what is shuffled has a row for each gene, variant and block, however many samples there are and however few of them have a
    cell. The sums of a block are matrix products, or, where these would be of zeros, sums over the pairs of cells that meet. r, p and z are
    null where a side does not vary."""
    links = sample_numbers(gte)
    place = lambda df, c: df.where(F.col("chr").isNotNull() & F.col(c).isNotNull()).withColumn(c, F.col(c).cast("long"))
    # arrays are read for the sizes of blocks and for the blocks
    g = written(normal_expression(expr, links).join(place(genes.select("gene", "chr", "tss"), "tss"), "gene"), "genes")
    v = written(tested_genotypes(genotypes, links, maf, call, hwe).join(place(variants.select("snp", "chr", "pos"), "pos"), "snp"), "variants")
    at = F.floor(F.col("tss") / window)
    g = g.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    v = v.withColumn("_b", F.floor(F.col("pos") / window))
    bucket = ["dataset", "chr", "_b"]
    sizes = lambda df, name: df.groupBy(*bucket).agg(F.count(F.lit(1)).alias(name), F.sum(F.size("k")).alias(f"{name}_cells"))
    of_set = links.groupBy("dataset").agg(F.count(F.lit(1)).alias("_samples"))
    blocks = sizes(g, "_gs").join(sizes(v, "_vs"), bucket).join(of_set, "dataset")  # a row for each bucket that has both
    shared = F.col("_gs_cells") / F.col("_gs") * F.col("_vs_cells") / F.col("_vs") / F.col("_samples")  # samples that a pair has, if they fall anyhow
    more = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(min_obs)) / shared))
    cut = lambda name, most: F.greatest(F.lit(1), F.ceil(F.col(name) / (more * most)), F.ceil(F.col(f"{name}_cells") / CELLS)).cast("int").alias(name)
    blocks = blocks.select(*bucket, cut("_gs", GENES), cut("_vs", VARIANTS))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    g = g.join(blocks, bucket).select(*bucket, own("gene", "_gs").alias("_g"), every("_vs").alias("_v"), "gene", "tss", "k", "y")
    v = v.join(blocks, bucket).select(*(F.col(c).alias(c) for c in bucket), own("snp", "_vs").alias("_v"), every("_gs").alias("_g"), "snp", "pos", "k", "g")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((g, "dataset"), (g, "gene"), (v, "snp"))]

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, n, r = _correlated(left, right, window, min_obs) if left.num_rows and right.num_rows else (np.zeros(0, int),) * 4
        one, other = left.take(pa.array(i)), right.take(pa.array(j))
        distance = pa.array(other.column("pos").to_numpy() - one.column("tss").to_numpy(), pa.int64())
        columns = [one.column("dataset"), one.column("gene"), other.column("snp"), distance, pa.array(n.astype(np.int64)), pa.array(r.astype(float), from_pandas=True)]
        return pa.Table.from_arrays(columns, ["dataset", "gene", "snp", "distance", "n", "r"])

    keys = [*bucket, "_g", "_v"]
    out = g.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(work, f"dataset {kinds[0]}, gene {kinds[1]}, snp {kinds[2]}, distance long, n long, r double")
    out = out.withColumn("p", correlation_p(F.col("r"), F.col("n")))
    return out.withColumn("z", F.signum("r") * -normal_quantile(F.greatest(F.col("p"), F.lit(1e-300)) / 2))
