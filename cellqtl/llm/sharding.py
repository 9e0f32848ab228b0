"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A row's source block is drawn once and written down. How many of a block's rows go to each shard is drawn exactly
(multivariate hypergeometric, one block after another), so shard sizes are fixed beforehand and differ by one row at most.
Rows are permuted inside their block, cut along the drawn counts, exchanged, and permuted again inside the shard.

Defined cases: null text has size 16 and checksum 0 of the empty string; null ids are rows like others; repeated rows get
places of their own; an empty table gives an empty result; extra columns are ignored by the query and kept by
:func:`assign_shards`, but for columns called shard and slot, which its own take the place of.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, save, table

#: Rows of a block at most on average, and the largest number of blocks; the matrix has blocks x shards cells.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 4096
#: Cells per shard of the second permutation: a shard is ordered in this many pieces.
PIECES = 64


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """blocks x shards; row sums are counts, column sums differ by one at most, each entry as a uniform shuffle deals it."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        # the last blocks take what is left, so column sums hold exactly
        out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[i]
    return out


def _number(*cols: Column | str, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def assign_shards(rows: DataFrame, keys: list[str], shards: int, seed: int = 11) -> DataFrame:
    """``rows`` with shard and slot. ``keys`` order rows; rows equal in all of them are interchangeable. ``rows`` must be
    narrow: it is what moves (twice), so shuffle keys and let the payload follow once by its key."""
    spark = rows.sparkSession
    rows = rows.drop(*({"shard", "slot"} - set(keys)))
    block, ends, at, mix, piece, rank, start = fresh(rows, "_block", "_ends", "_at", "_mix", "_piece", "_rank", "_start")
    n = rows.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n // BLOCK_ROWS), min(n, 8))))
    # the block number is written, so a recomputed task cannot deal its rows differently
    drawn = F.pmod(_number(*keys, seed=f"{seed}b") + F.floor(F.rand(seed) * 1e6).cast("long"), F.lit(blocks)).cast("int")
    placed = save(rows.withColumn(block, drawn), "blocks")
    found = {r[0]: r[1] for r in placed.groupBy(block).count().collect()}  # MAX_BLOCKS rows at most
    counts = np.array([found.get(i, 0) for i in range(blocks)], np.int64)
    edges = communication_matrix(counts, shards, seed).cumsum(1)
    matrix = spark.createDataFrame([(i, [int(x) for x in edges[i]]) for i in range(blocks)], f"{block} int, {ends} array<long>")
    inside = Window.partitionBy(block).orderBy(_number(*keys, seed=f"{seed}p"), *keys)
    dealt = (
        placed.withColumn(at, F.row_number().over(inside))
        .join(F.broadcast(matrix), block)  # MAX_BLOCKS x shards numbers at most
        .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(at))).cast("int"))
        .drop(ends, block, at)
    )
    mixed = _number(*keys, seed=f"{seed}q")
    pieces = save(dealt.withColumn(mix, mixed).withColumn(piece, F.shiftrightunsigned(mix, 58).cast("int")), "dealt")
    sizes = pieces.groupBy("shard", piece).agg(F.count(F.lit(1)).alias(at))
    before = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", piece, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(start))
    order = Window.partitionBy("shard", piece).orderBy(mix, *keys)
    return (
        pieces.withColumn(rank, F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", piece])  # shards x PIECES rows
        .withColumn("slot", F.col(start) + F.col(rank))
        .drop(piece, mix, rank, start)
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = assign_shards(rows, ["doc_id", "size", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
