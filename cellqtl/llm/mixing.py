"""Mixing sources to target weights with repetition rates; DataFrame and SQL functions only.

Tokens are summed by source, each source's target follows from its weight, and a document is emitted floor(rate) times plus
once more when its hash, read as a number in [0, 1), falls below the rate's fraction.

Defined cases: null text has size 0; null source is a source of its own, last in order; a source without tokens has
target 0 and rate 0, so its documents are not taken; repeated rows share their draw, rows without an id draw by their text; an
empty table gives an empty result; extra columns are kept by :func:`mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, save, table

#: A source is repeated this many times at most.
MOST = 3
SPACE = r"[\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Number of words. A split leaves an empty part before leading and after trailing white space, which is taken out."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), SPACE), "")), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash of the seed and the id as a number in [0, 1), the same in every engine that has MD5."""
    own = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit("mix-1:"), F.coalesce(F.col(doc_id).cast("string"), own)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target. Weights are 1, 2, 3, repeating, in code point order with null last; a target
    stops at MOST times its source's size and what exceeds it is shared by weight again. With sources in the order of
    cap / weight, the first k are capped and the rest share what is left: one pass instead of rounds.

    One row per source: the only windows without a key, over the aggregate and not over documents; a source per host is
    some 10**6 rows of three numbers."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    up_to = by.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        .withColumn("capped", F.col("left_size") * F.col("weight") > F.col("cap") * F.col("left_weight"))
    )
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("left_size").alias("s"), F.col("left_weight").alias("w"))))
    w = w.withColumn("level", first.over(all_rows))
    share = F.col("level.s").cast("double") * F.col("weight") / F.col("level.w")
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def rates(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rate: one row per source of ``sized`` (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets(save(sums, "sources")).withColumn("rate", rate)


def copies(rate: Column, u: Column) -> Column:
    """How often a document is taken: floor(rate) times and once more where its draw is below the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as it is taken, all columns."""
    source, rate, n = fresh(docs, "_source", "_rate", "_copies")
    t = rates(docs.select("source", words().alias("size"))).select(F.col("source").alias(source), F.col("rate").alias(rate))
    # sources may be many: the hint is left to the optimiser, which knows the size; skewed sources are split by AQE
    taken = docs.join(t, docs["source"].eqNullSafe(t[source])).withColumn(n, copies(F.col(rate), draw())).where(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = save(docs.select("doc_id", "source", words().alias("size"), draw().alias("u")), "sizes")  # texts are read once
    t = rates(sized).withColumnRenamed("source", "_source")
    out = sized.join(t, sized["source"].eqNullSafe(t["_source"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("u"))).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(CAST(doc_id AS VARCHAR), 'null:' || md5(COALESCE(text, ''))) AS own, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, SUM(source_size) OVER () - COALESCE(SUM(cap) OVER o, 0) AS left_size,
  SUM(weight) OVER () - COALESCE(SUM(weight) OVER o, 0) AS left_weight FROM w
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT left_size AS ls, left_weight AS lw FROM r WHERE NOT left_size * weight > cap * left_weight
  ORDER BY CAST(cap AS DOUBLE) / weight, left_size LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN left_size * weight > cap * left_weight THEN CAST(cap AS DOUBLE)
  ELSE CAST(ls AS DOUBLE) * weight / lw END AS target FROM r LEFT JOIN f ON TRUE),
m AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || own), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
