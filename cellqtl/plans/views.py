"""Inputs of the library's shapes derived from the test tables; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import count_delta

TABLES = {"lineitem", "orders", "customer", "nation", "region", "part", "supplier", "events"}

VIEWS = {
    "v_counts": "SELECT l_orderkey AS barcode, l_partkey AS gene, CAST(SUM(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY l_orderkey, l_partkey",
    "v_counts_open": "SELECT l_orderkey AS barcode, l_partkey AS gene, CAST(SUM(l_quantity) AS BIGINT) AS cnt FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_partkey",
    "v_cells": "SELECT o_orderkey AS barcode, o_custkey AS sample, o_orderpriority AS cell_type, CASE o_orderstatus WHEN 'P' THEN 'doublet' ELSE 'singlet' END AS droplet, year(o_orderdate) AS pool FROM orders",
    "v_genes": "SELECT p_partkey AS gene, p_name AS symbol, p_brand = 'Brand#1' AS is_rb, p_type = 'ECONOMY' AS is_mt, 1 + p_partkey % 22 AS chr, (p_partkey * 7919) % 10000000 AS chr_start, (p_partkey * 7919) % 10000000 + 100 * p_size AS chr_end, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part",
    "v_variants": "SELECT s_suppkey AS snp, 1 + s_suppkey % 22 AS chr, (s_suppkey * 104729) % 10000000 AS pos, CASE s_nationkey % 4 WHEN 0 THEN 'A/G' WHEN 1 THEN 'G/A' WHEN 2 THEN 'T/C' ELSE 'CT/C' END AS alleles FROM supplier",
    "v_effects": "SELECT flag, gene, snp, p, beta, ea, n FROM (SELECT l_returnflag AS flag, l_partkey AS gene, l_suppkey AS snp, CAST((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 9973 + 1 AS DOUBLE) / CAST(9974 AS DOUBLE) AS p, l_discount - CAST(0.05 AS DOUBLE) AS beta, CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'G' END AS ea, CAST(l_quantity AS BIGINT) AS n, ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_partkey, l_suppkey ORDER BY (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 9973, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity) AS rn FROM lineitem) x WHERE rn = 1",
    "v_donors": "SELECT c_custkey AS sample, c_mktsegment AS dataset, n_nationkey AS pool, r_name AS ancestry FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_genotypes": "SELECT s_suppkey AS snp, c_custkey AS sample, CASE WHEN (s_suppkey * 31 + c_custkey * 17) % 97 = 0 THEN NULL ELSE CAST((s_suppkey * 31 + c_custkey * 17) % 97 % 3 AS DOUBLE) END AS dosage FROM supplier CROSS JOIN customer WHERE c_custkey % 10 = 0",
    "v_expr": "SELECT l_partkey AS gene, o_custkey AS sample, CAST(SUM(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey",
    "v_dense": "SELECT l_partkey % 60 AS gene, o_custkey % 40 AS sample, CAST(SUM(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey % 60, o_custkey % 40",
    "v_genotypes_all": "SELECT l_suppkey AS snp, o_custkey AS sample, CASE WHEN CAST(SUM(l_quantity) AS BIGINT) % 29 = 0 THEN NULL ELSE CAST(CAST(SUM(l_quantity) AS BIGINT) % 3 AS DOUBLE) END AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey",
    "v_tall": "SELECT l_partkey AS gene, o_custkey % 12 AS sample, CAST(SUM(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey % 12",
    "v_calls": "SELECT a.event_id AS barcode, a.user_id % 10 AS pool, a.event_type AS tool_a, b.event_type AS tool_b FROM events a JOIN events b ON b.event_id = a.event_id + 1",
    "v_qc": "SELECT event_id AS barcode, value AS feature, event_type AS dataset, user_id % 5 AS cell_type FROM events",
}
VIEWS["v_study"] = (
    "SELECT flag, gene, snp, p, beta, ea, n, CASE ea WHEN 'A' THEN 'A/G' ELSE 'G/A' END AS alleles, CASE ea WHEN 'A' THEN 'G' ELSE 'A' END AS oa, "
    "(gene * 7 + snp * 13 + n) % 50 / CAST(1000 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS beta_se, (gene + snp) % 90 / CAST(100 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS af, "
    f"beta * (1 + snp % 7) * 20 AS z FROM ({VIEWS['v_effects']}) e"
)
VIEWS["v_full"] = (
    "SELECT o_orderkey AS barcode, o_custkey AS sample, o_orderpriority AS cell_type, CASE o_orderstatus WHEN 'P' THEN 'doublet' ELSE 'singlet' END AS droplet, year(o_orderdate) AS pool, "
    "CASE WHEN o_totalprice > 100000 THEN 'NotOutlier' ELSE 'Outlier' END AS tag, r_name AS ancestry, CASE WHEN o_orderkey % 5 = 0 THEN 'IFN' ELSE 'UT' END AS treatment, c_mktsegment AS dataset "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


#: Variants of one task that pairs them with all samples.
VARIANTS = 250
#: Line items of one task where they are dealt by their number.
ROWS = 250_000


def tasks_of(rows: DataFrame) -> int:
    """One for each ``ROWS``."""
    return max(1, -(-rows.count() // ROWS))


def view(spark: SparkSession, sf_dir: str, name: str, flag: str | None = None, deal: tuple[str, ...] = ()) -> DataFrame:
    """One of the views over the tables in sf_dir, without names in the catalog. ``flag``: of a view of effects, the rows of this one; the view's window is
    by flag, but Spark moves no filter on the renamed column below it, so rows of other flags would be sorted and shuffled. ``deal``: line items, with
    their orders where the view joins both, are dealt by these columns to a task for each ``ROWS`` of them, whatever filter the view has. So views that are
    summed by these columns are joined on them without another shuffle, and what a task holds does not grow with the tables."""
    sql, used = VIEWS[name], {}
    for t in sorted(TABLES):
        if f" {t}" in f" {sql}":
            used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    used = {t: df for t, df in used.items() if f"{{{t}}}" in sql}
    if name == "v_genotypes":  # every pair of both: variants, of which one file has many, are dealt to tasks, and samples are sent to all
        used["supplier"] = used["supplier"].repartition(max(1, -(-used["supplier"].count() // VARIANTS)))
        used["customer"] = F.broadcast(used["customer"])
    if deal:
        tasks, both = tasks_of(used["lineitem"]), "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
        if both in sql:
            rows = used["lineitem"].join(used.pop("orders"), F.expr("l_orderkey = o_orderkey"))
            sql = sql.replace(both, "{lineitem}")
        else:
            rows = used["lineitem"]
        used["lineitem"] = rows.repartition(tasks, *deal)
    if flag:
        used["lineitem"] = used["lineitem"].where(F.col("l_returnflag") == flag)
        return spark.sql(sql, **used).where(F.col("flag") == flag)
    return spark.sql(sql, **used)


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts beside those of open line items (J7)."""
    by = ("l_orderkey", "l_partkey")
    return count_delta(view(spark, sf_dir, "v_counts", deal=by), view(spark, sf_dir, "v_counts_open", deal=by))


def oracle(sql: str) -> str:
    """The SQL with the views it uses in front of it."""
    used = [n for n in VIEWS if n in sql]
    used = [n for n in used if not any(n != m and n in m and n not in sql.replace(m, "") for m in used)]
    if not used:
        return sql
    own = sql.lstrip()
    start = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE ") else "WITH "
    return start + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + (", " + own.removeprefix(start) if own.startswith("WITH ") else " " + own)
