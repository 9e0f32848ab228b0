"""Delimited tables, sharded results, matrices, packed columns, counts as triples."""

from __future__ import annotations

import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str | list[str], sep: str = "\t", header: bool = True, columns: list[str] | None = None, must_contain: str | None = None) -> DataFrame:
    """S1. Delimited text, gzip or plain, every column a string. ``columns`` names those of a file without header.
    ``must_contain`` keeps rows of which some cell holds the substring."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    if columns and not header:
        df = df.toDF(*columns)
    if must_contain is not None:
        df = df.where(F.concat_ws(sep, *df.columns).contains(must_contain))
    return df


def read_sharded(spark: SparkSession, template: str, values: dict[str, list[str]], fallback: str | None = None) -> DataFrame:
    """S2. The tables of a path template with <KEY> parts, one after another, in one read; missing shards are left out. A shard that is
    missing or empty is read from ``fallback``, if that has it. Headers may differ: columns meet by name, and those that a shard lacks are null. Only
    the first line of each shard is read for that; shards of equal headers are read together."""

    def read(of: str) -> DataFrame | None:
        path, form = of, re.escape(of)
        for key, options in values.items():
            path = path.replace(f"<{key}>", "{" + ",".join(map(str, options)) + "}")
            form = form.replace(re.escape(f"<{key}>"), "(" + "|".join(re.escape(str(o)) for o in options) + ")", 1)
        try:
            files = [r.path for r in spark.read.format("binaryFile").load(path).where("length > 0").select("path").collect()]  # a row for each shard
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        csv = lambda p: spark.read.csv(p, sep="\t", header=True, inferSchema=False, enforceSchema=False)
        alike = defaultdict(list)
        with ThreadPoolExecutor(8) as pool:
            for file, header in zip(files, pool.map(lambda f: tuple(csv(unquote(f)).columns), files), strict=True):
                alike[header].append(unquote(file))
        alike.pop((), None)
        if not alike:
            return None
        order = sorted(values, key=of.index)
        form = form.removeprefix("file://").replace("file:", "")
        keyed = [csv(of_one).select("*", *(F.regexp_extract("_metadata.file_path", form, i + 1).alias(f"_{k}") for i, k in enumerate(order))) for of_one in alike.values()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)

    keys = [f"_{k}" for k in values]
    found, other = read(template), read(fallback) if fallback else None
    if found is None and other is None:
        raise FileNotFoundError(template)
    if found is None:
        return other.drop(*keys)
    if other is not None:
        found = found.unionByName(other.join(found.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    return found.drop(*keys)


def read_counts(spark: SparkSession, triples: str, genes: str, barcodes: str) -> DataFrame:
    """S5. Counts from a coordinate text (gene index, barcode index, count; % starts a comment, then one line of sizes) and
    two index files (index, name), both counted from 1."""
    part = F.split("value", r"\s+")
    lines = spark.read.text(triples).where("NOT startswith(value, '%')").select(*(part[i].cast("long").alias(c) for i, c in enumerate(("g", "b", "count"))))
    g = read_table(spark, genes, header=False, columns=["g", "gene"]).withColumn("g", F.col("g").cast("long"))
    b = read_table(spark, barcodes, header=False, columns=["b", "barcode"]).withColumn("b", F.col("b").cast("long"))
    return lines.join(g, "g").join(b, "b").select("barcode", "gene", "count")


def write_partitioned(df: DataFrame, path: str, by: list[str], text: bool = False) -> None:
    """S6. One folder per value of ``by``, as Parquet or gzipped tab-separated text."""
    w = df.write.partitionBy(*by)
    w.csv(path, sep="\t", header=True, compression="gzip") if text else w.parquet(path)


def unpack_packed(df: DataFrame, prefix: str) -> DataFrame:
    """S7. A column ``prefix(A;B;C)`` of values joined by ``;`` becomes rows of dataset and value; ``-`` is null."""
    column = next(c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\(.*\)", c))
    names = F.array(*(F.lit(n) for n in column[len(prefix) + 1 : -1].split(";")))
    items = F.arrays_zip(names.alias("dataset"), F.split(F.col(f"`{column}`"), ";").alias("value"))
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.explode(items).alias("_")).select(*rest, F.col("_.dataset"), F.expr("nullif(_.value, '-')").alias("value"))


def matrix_to_long(df: DataFrame, index: str, name: str = "sample", value: str = "value") -> DataFrame:
    """S8. A wide matrix to one row per cell."""
    return df.unpivot([index], [c for c in df.columns if c != index], name, value)


def long_to_matrix(df: DataFrame, index: str, name: str, value: str, names: list) -> DataFrame:
    """S8. One row per ``index``, one column per name, the mean of repeated cells."""
    return df.groupBy(index).pivot(name, names).agg(F.avg(value))


def drop_repeated_index(df: DataFrame, index: str, keep_first: str | None = None) -> DataFrame:
    """W5. Rows whose index is repeated go, all of them; with ``keep_first``, the one first by that column stays."""
    w = Window.partitionBy(index)
    if keep_first:
        return df.withColumn("_n", F.row_number().over(w.orderBy(keep_first))).where("_n = 1").drop("_n")
    return df.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")
