"""Exact top-k inner products by dual-tree search on cover trees.

Top-level centers are picked farthest first from a sample of at most ``SAMPLE`` rows; every row goes to the cell of its nearest center,
and cells are cut into blocks of bounded size. A query is first searched in one block of its most promising cell, which gives it
a kth score to start from; it is then sent to those cells alone where ``q.c + |q| r`` (center c, covering radius r) reaches that
score. In a task, a block and the queries that came to it are both indexed as cover trees. No score between two nodes exceeds
``cq.cr + |cq| rr + |cr| rq + rq rr``; a node pair is left out when that stays below the worst kth score of the query node's
group. What passes is scored in 64-bit integers, so the result is exact; blocks' results are merged by a rank.

The trees are built top down: the children of a node have their centers among its points, at least radius / BASE apart, and each
point belongs to the child of its nearest center, within radius / BASE of it unless the node has too few points to be split
further. Radii are measured, so bounds hold whatever the levels are.

Defined cases: null vectors and vectors with a null or non-finite component take no part; vectors of different lengths are
not compared; rows with the query's own vec_id are not candidates for it; repeated query rows (same id and vector) count
once, repeated candidate rows each; null ids take no part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table

#: Rows of a block of candidates and of queries, about.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048
#: Rows that centers are picked from, most centers, rows of a cell aimed at. Centers decide about speed alone.
SAMPLE, CENTERS, CELL = 4096, 1024, 2048
LEAF, BASE = 64, 1.3


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, center: int) -> None:
        self.rows, self.center = rows, points[center]
        self.norm = float(np.sqrt((self.center**2).sum()))
        self.radius = float(np.sqrt(((points[rows] - self.center) ** 2).sum(1).max()))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, center: int = 0) -> Node:
    """Children's centers cover the node's points within radius / BASE and keep that far apart (greedy, farthest first)."""
    rows = np.arange(len(points)) if rows is None else rows
    node = Node(points, rows, center)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    own = points[rows]
    nearest = ((own - node.center) ** 2).sum(1)
    owner, centers = np.zeros(len(rows), int), [center]
    while len(centers) <= len(rows) // (LEAF // 2):
        far = int(nearest.argmax())
        if nearest[far] <= (node.radius / BASE) ** 2:
            break
        d = ((own - own[far]) ** 2).sum(1)
        closer = d < nearest
        owner[closer], nearest = len(centers), np.minimum(nearest, d)
        centers.append(int(rows[far]))
    if len(centers) > 1:
        node.children = [cover_tree(points, rows[owner == i], c) for i, c in enumerate(centers) if (owner == i).any()]
    return node


def dual_search(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best k (ids, scores) per query, ties to the smaller id; missing places have id -1 and the least score. ``known``: a score
    of each query that its kth one reaches at least; what stays below may be missing."""
    least = np.iinfo(np.int64).min
    floor = np.full(len(q), least) if known is None else known
    ids, scores = np.full((len(q), k), -1, np.int64), np.full((len(q), k), least, np.int64)
    qf, pf = q.astype(float), p.astype(float)

    def score(rows: np.ndarray, cols: np.ndarray) -> None:
        big = max(np.abs(qf[rows]).max(initial=0), 1) * max(np.abs(pf[cols]).max(initial=0), 1) * q.shape[1]
        # doubles are exact for integers under 2 ** 53
        s = (qf[rows] @ pf[cols].T).astype(np.int64) if big < 2.0**52 else q[rows] @ p[cols].T
        c = np.broadcast_to(p_ids[cols], s.shape)
        s = np.where(c == q_ids[rows][:, None], least, s)
        s, c = np.concatenate([scores[rows], s], 1), np.concatenate([ids[rows], c], 1)
        c = np.where(s == least, -1, c)
        best = np.lexsort((c, -np.where(s == least, least + 1, s)), axis=1)[:, :k]
        scores[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)

    def visit(a: Node, todo: list[Node]) -> None:
        """All reference nodes for a query node, the most promising first."""
        worst = np.maximum(scores[a.rows, -1], floor[a.rows]).min()
        inner = np.array([float(a.center @ b.center) for b in todo])
        bound = inner + np.array([a.norm * b.radius + b.norm * a.radius + a.radius * b.radius for b in todo])
        for i in np.argsort(-bound):
            b = todo[i]
            if bound[i] + 1 + 1e-9 * abs(bound[i]) < worst:
                break
            if a.children:
                for x in a.children:
                    visit(x, [b])
            elif b.children:
                visit(a, b.children)
            else:
                score(a.rows, b.rows)
            worst = np.maximum(scores[a.rows, -1], floor[a.rows]).min()

    if len(q) and len(p):
        visit(cover_tree(qf), [cover_tree(pf)])
    return ids, scores


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        known = queries["known"].fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        ids, scores = dual_search(_rows(queries["v"]), queries["query_id"].to_numpy(), _rows(candidates["v"]), candidates["vec_id"].to_numpy(), k, known)
        out = pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), k), "query_id": np.repeat(queries["query_id"].to_numpy(), k), "vec_id": ids.ravel(), "score": scores.ravel()})
        return out[scores.ravel() > np.iinfo(np.int64).min]

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, query_id, vec_id, score: the best k of a block for each query (query, query_id, v, known) that was sent to it.
    Both sides have dim, cell and block. Where many queries met a block, it is searched in several tasks."""
    key = ["dim", "cell", "block"]
    parts = queries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    q = queries.join(parts, key).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    p = candidates.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*key, "part"]
    sides = p.select(*key, "vec_id", "v").groupBy(*key).cogroup(q.select(*key, "query", "query_id", "v", "known").groupBy(*key))
    return sides.applyInPandas(_search(k), "query long, query_id long, vec_id long, score long")


def pick_centers(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centers of each length of vectors in the sample, farthest first, the vector nearest to the sample's mean before all."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(SAMPLE).distinct().collect()
    by: dict[int, list] = {}
    for r in sorted(r[0] for r in rows):
        by.setdefault(len(r), []).append(r)
    out = {}
    for dim, own in by.items():
        x = np.array(own, float).reshape(len(own), dim)
        first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        chosen, nearest = [first], ((x - x[first]) ** 2).sum(1)
        while len(chosen) < min(CENTERS, -(-n // CELL)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[dim] = x[chosen]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def assign(vectors: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (vec_id, v, dim) with cell and the distance from its center. Lengths that the sample lacks have one cell, -1, about 0."""

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = _matrix(part.column(1), dim)
                c = centers.get(dim, np.zeros((1, dim)))
                d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
                cell = d.argmin(1)
                far = np.sqrt(((x - c[cell]) ** 2).sum(1))
                cell = cell if dim in centers else np.full(len(x), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "dim", "cell", "far"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(run, "vec_id long, v array<long>, dim int, cell int, far double")


def route(queries: DataFrame, centers: dict[int, np.ndarray], radii: dict[tuple[int, int], float], first: bool) -> DataFrame:
    """query, query_id, v, dim, known, cell, home: the cells a query has to look into (``first``: its most promising one
    alone; a query that knows no score: all), and its most promising one."""

    def run(batches):
        for b in batches:
            dims = b.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                if dim not in centers:  # one cell for all
                    at, cell, home = np.arange(part.num_rows), np.full(part.num_rows, -1), np.full(part.num_rows, -1)
                else:
                    q, c = _matrix(part.column(2), dim), centers[dim]
                    r = np.array([radii.get((dim, i), -np.inf) for i in range(len(c))])  # no row: nothing to find
                    inner = q @ c.T
                    norm = np.sqrt((q**2).sum(1))[:, None]
                    bound = np.where(np.isfinite(r), inner + norm * np.where(np.isfinite(r), r, 0), -np.inf)
                    best = np.where(np.isfinite(r), inner, -np.inf).argmax(1)
                    if first:
                        at, cell, home = np.arange(len(q)), best, best
                    else:
                        known = part.column(4).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(float)[:, None]
                        at, cell = np.nonzero(np.isfinite(bound) & (bound + 1 + 1e-9 * np.abs(bound) >= known))
                        home = best[at]
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(at)).columns, pa.array(cell.astype(np.int32)), pa.array(home.astype(np.int32))], ["query", "query_id", "v", "dim", "known", "cell", "home"]
                )

    rows = queries.select("query", "query_id", "v", "dim", "known")
    return rows.mapInArrow(run, "query long, query_id long, v array<long>, dim int, known long, cell int, home int")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v array<long>: floor(256 x) of the vectors that take part."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for vectors and queries with columns vec_id and v."""
    vectors = save(vectors.withColumn("dim", F.size("v")), "vectors")
    queries = queries.select("vec_id", "v").distinct().withColumnRenamed("vec_id", "query_id")
    queries = save(queries.withColumns({"dim": F.size("v"), "query": F.monotonically_increasing_id(), "known": F.lit(None).cast("long")}), "queries")
    centers = pick_centers(vectors, vectors.count())
    placed = save(assign(vectors, centers).withColumn("row", F.monotonically_increasing_id()), "cells")
    cells = save(placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).cast("int").alias("blocks")), "radii")
    radii = {(r["dim"], r["cell"]): r["radius"] for r in cells.where("cell >= 0").collect()}  # a row for each center
    # a cell of any size, copies of one vector as well, is dealt to blocks by the number of the row
    candidates = placed.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")
    seeds = save(search(candidates.where("block = 0"), route(queries, centers, radii, True).withColumn("block", F.lit(0)), k), "seeds")
    kth = seeds.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(f"n = {k}").select("query", F.col("least").alias("known"))
    sent = route(queries.drop("known").join(kth, "query", "left"), centers, radii, False).join(cells.select("dim", "cell", "blocks"), ["dim", "cell"])
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("NOT (cell = home AND block = 0)")
    best = seeds.union(search(candidates, save(sent, "sent"), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
