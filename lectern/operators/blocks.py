"""The nearest points of many queries in one pass over the points, by block matrix products.

A block of queries of bounded size is broadcast. Each task multiplies its points with it, tile by tile, and keeps the best k of
each query so far; it sends no more than those. Products only choose candidates: what counts is each candidate's own sum, which is the same wherever a
vector stands, so that equal vectors tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20  # of queries broadcast at a time
TILE = 4 << 20  # products computed at a time
MARGIN = 1e-9  # more than a product and a sum can differ by, scores being at most 1


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows, and the rows' norms. Null lists, null and non-finite components, zeros, and lengths other than the most frequent make rows of zeros, of norm 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    width = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    out, good = np.zeros((n, width)), sizes == width if width else np.zeros(n, bool)
    if good.any():
        values = column.filter(pa.array(good)).flatten().cast(pa.float64())
        out[good] = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(all="ignore"):
        norms = np.sqrt((out * out).sum(axis=1)) if width else np.zeros(n)
    bad = ~(np.isfinite(norms) & (norms > 0))
    out[bad], norms[bad] = 0.0, 0.0
    return out, norms


class Best:
    """For each query the k best (score, id) so far, ties to the smaller id; ids of points without a score come last."""

    def __init__(self, queries: np.ndarray, norms: np.ndarray, k: int):
        self.queries, self.norms, self.k = queries, norms, k
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * len(queries)

    def _merge(self, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.held[j][0], scores)), np.concatenate((self.held[j][1], ids))
        order = np.lexsort((i, -s))[: self.k] if i.dtype != object else np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[: self.k], int)
        self.held[j] = s[order], i[order]
        if len(order) == self.k:
            self.least[j] = s[order[-1]]

    def add(self, points: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(self.queries)))
        alike = points.shape[1] == self.queries.shape[1]  # no vector of another length has a score
        for a in range(0, len(points), step):
            p, own, norm = points[a : a + step], ids[a : a + step], norms[a : a + step]
            products = np.full((len(p), len(self.queries)), -np.inf)
            if alike:
                np.divide(p @ self.queries.T, norm[:, None] * self.norms, out=products, where=(norm[:, None] > 0) & (self.norms > 0))
            full = products.max(axis=0) >= self.least - MARGIN
            for j in np.flatnonzero(full).tolist():
                s = products[:, j]
                near = np.arange(len(s))
                if len(s) > self.k:
                    near = np.flatnonzero(s >= max(self.least[j], np.partition(s, -self.k)[-self.k]) - MARGIN)
                scored = ~np.isneginf(s[near])
                exact = np.full(len(near), -np.inf)
                if scored.any():
                    chosen = near[scored]
                    exact[scored] = (p[chosen] * self.queries[j]).sum(axis=1) / (norm[chosen] * self.norms[j])
                self._merge(j, exact, own[near])

    def rows(self, names: np.ndarray):
        """(query, id, score) columns of all that is held; no score is null."""
        n = [len(s) for s, _ in self.held]
        scores = np.concatenate([s for s, _ in self.held]) if n else np.zeros(0)
        return np.repeat(names, n), [x for _, i in self.held for x in i.tolist()], pa.array(scores, mask=np.isneginf(scores))


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def nearest(points: DataFrame, queries: DataFrame, k: int, column: str, id_col: str) -> DataFrame:
    """(query_id, id, score, rank): for each row (query_id, qv) of queries its k nearest points by cosine."""
    from lectern._workers import importable

    spark = points.sparkSession
    importable(spark)
    kind = {"query": queries.schema["query_id"].dataType.simpleString(), "id": points.schema[id_col].dataType.simpleString()}
    unit = points.select(F.col(f"`{column}`").alias("v"), F.col(f"`{id_col}`").alias("id"))
    total = queries.agg(F.coalesce(F.sum(F.size("qv").cast("bigint") * 8 + 64), F.lit(0))).first()[0]
    parts = max(1, -(-total // BLOCK_BYTES))
    out = None
    for i in range(parts):
        block = queries.select("query_id", "qv") if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "qv")
        found = block.toArrow()  # about BLOCK_BYTES
        vectors, norms = matrix(found.column("qv"))
        sent = spark.sparkContext.broadcast((np.array(found.column("query_id").to_pylist(), object), vectors, norms))

        def run(batches, sent=sent):
            names, vectors, norms = sent.value
            best = Best(vectors, norms, k)
            for b in batches:
                best.add(*matrix(b.column(0)), _ids(b.column(1)))
            query, ids, scores = best.rows(names)
            yield pa.RecordBatch.from_arrays([pa.array(query.tolist()), pa.array(ids), scores], ["query_id", "id", "score"])

        rows = unit.mapInArrow(run, f"query_id {kind['query']}, id {kind['id']}, score double") if k else spark.createDataFrame([], f"query_id {kind['query']}, id {kind['id']}, score double")
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
