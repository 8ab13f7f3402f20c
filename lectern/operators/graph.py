"""Single searches over navigable small-world graphs of points, one graph for each block.

Points are dealt into blocks of bounded size. In a task a block's points are linked to near ones in different directions, and a few of them, the
pivots, are where searches enter; a search looks at the pivots, then follows links while they lead closer, and so sees a small part of the block. What it
finds is scored exactly. A filter restricts what is found, not where links lead; where it leaves few points of a block, those are scored one by one. The
exact scan (`search.top_k`) stays, for whoever asks and where a graph finds too little.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern._workers import importable

BLOCK = 20_000  # points of a graph
NEAR = 48  # nearest points that links are chosen among
LINKS = 16  # links that a point chooses; as many again may come from points that choose it
BEAM = 96  # points that a search keeps in view
FEW = 0.1  # share of a block's points up to which a filter's are all scored
TILE_BYTES = 16 << 20  # of similarities, or of vectors, that a step works on: a task holds a few of these besides its block

GRAPH = "block int, ids array<string>, vectors binary, links binary, pivots binary"


def _nearest(unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the k most similar others and their similarity, best first."""
    n = len(unit)
    at, sim = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    step = max(1, TILE_BYTES // (4 * n))
    for a in range(0, n, step):
        s = unit[a : a + step] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        np.negative(s, out=s)  # the least first
        best = np.argpartition(s, k - 1, axis=1)[:, :k] if k < n else np.argsort(s, axis=1)[:, :k]
        found = np.take_along_axis(s, best, 1)
        order = np.argsort(found, axis=1, kind="stable")
        at[a : a + step], sim[a : a + step] = np.take_along_axis(best, order, 1), -np.take_along_axis(found, order, 1)
    return at, sim


def _spread(unit: np.ndarray, at: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Which of the near points to link: none that is closer to one already linked than to the point itself, so that links lead in different directions."""
    chosen = np.zeros(at.shape, bool)
    step = max(1, TILE_BYTES // (4 * at.shape[1] * max(at.shape[1], unit.shape[1])))
    for a in range(0, len(at), step):
        near, own, keep = unit[at[a : a + step]], sim[a : a + step], chosen[a : a + step]
        between = np.einsum("nid,njd->nij", near, near, optimize=True)
        for r in range(at.shape[1]):
            covered = ((between[:, r, :r] > own[:, r, None]) & keep[:, :r]).any(axis=1) if r else np.zeros(len(near), bool)
            keep[:, r] = ~covered & (keep[:, :r].sum(axis=1) < LINKS)
        # Points with few directions take their nearest besides.
        spare = LINKS - keep.sum(axis=1)
        keep |= ~keep & (np.cumsum(~keep, axis=1) <= spare[:, None])
    return chosen


def linked(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, pivots) of points, none of them zero: up to 2 * LINKS neighbours of each, -1 where there are fewer, and where searches enter."""
    n = len(vectors)
    unit = (vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    links = np.full((n, 2 * LINKS), -1, np.int32)
    if n > 1:
        at, sim = _nearest(unit, min(NEAR, n - 1))
        chosen = _spread(unit, at, sim)
        row, col = np.nonzero(chosen)
        a, b, s = row, at[row, col], sim[row, col]
        # Own links and those of points that chose this one, the most similar first.
        pairs = np.concatenate((np.stack((a, b), 1), np.stack((b, a), 1)))
        _, first = np.unique(pairs[:, 0].astype(np.int64) * n + pairs[:, 1], return_index=True)
        own, s = np.arange(len(pairs)) < len(a), np.concatenate((s, s))
        own, pairs, s = own[first], pairs[first], s[first]
        order = np.lexsort((-s, ~own, pairs[:, 0]))
        own, pairs = own[order], pairs[order]
        start = np.searchsorted(pairs[:, 0], np.arange(n))
        place = np.arange(len(pairs)) - start[pairs[:, 0]]
        fits = place < 2 * LINKS
        links[pairs[fits, 0], place[fits]] = pairs[fits, 1]
    return links, _pivots(unit)


def _pivots(unit: np.ndarray) -> np.ndarray:
    """Twice the root of n points far from each other, so that every larger cluster has one, and as many at random."""
    n = len(unit)
    m = max(1, int(2 * n**0.5))
    far, nearest = [0], unit @ unit[0]
    while len(far) < min(m, n):
        far.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[far[-1]])
    return np.unique(np.concatenate((far, np.random.RandomState(n).permutation(n)[:m]))).astype(np.int32)


def walk(vectors: np.ndarray, norms: np.ndarray, links: np.ndarray, pivots: np.ndarray, query: np.ndarray, k: int, allowed: np.ndarray | None = None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k allowed points of highest cosine that a walk finds, best first."""
    length = np.linalg.norm(query)
    exact = lambda at: (vectors[at].astype(np.float64) * query).sum(axis=1) / (norms[at] * length)
    if allowed is not None and allowed.sum() <= max(beam, FEW * len(vectors)):
        at = np.flatnonzero(allowed)
    else:
        q = (query / length).astype(np.float32)
        beam = max(beam, k)
        seen = np.zeros(len(vectors), bool)
        open_: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []

        def meet(at: np.ndarray) -> None:
            seen[at] = True
            for s, i in zip(((vectors[at] @ q) / norms[at]).tolist(), at.tolist()):
                if len(best) < beam or s > best[0][0]:
                    heapq.heappush(open_, (-s, i))
                    if allowed is None or allowed[i]:
                        heapq.heappush(best, (s, i))
                        if len(best) > beam:
                            heapq.heappop(best)

        meet(pivots)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            at = links[i]
            at = at[at >= 0]
            at = at[~seen[at]]
            if len(at):
                meet(at)
        at = np.array([i for _, i in best], np.int64)
    scores = exact(at) if len(at) else np.zeros(0)
    order = np.lexsort((at, -scores))[:k]
    return at[order], scores[order]


def build(points: DataFrame, column: str = "vector", id_col: str = "id", count: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each block of points: ids, vectors, links, pivots. Points whose vector is null, zero or not finite, or of another length than the block's, are in no graph."""
    spark = points.sparkSession
    importable(spark)
    blocks = max(1, -(-(points.count() if count is None else count) // block))

    def run(batches):
        from lectern.operators.blocks import matrix

        ids, rows = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            rows.append(b.column(1))
        if not ids:
            return
        vectors, norms = matrix(pa.chunked_array(rows))
        good = np.flatnonzero(norms > 0)
        vectors = vectors[good].astype(np.float32)
        if len(good):
            links, pivots = linked(vectors)
            kept = [ids[i] for i in good.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([kept], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (vectors, links, pivots))], ["block", "ids", "vectors", "links", "pivots"])

    dealt = points.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{column}`").alias("v")).repartition(blocks, "id")
    return dealt.mapInArrow(run, GRAPH).withColumn("block", F.spark_partition_id())


def search(graph: DataFrame, vector: Sequence[float], k: int, allowed: DataFrame | None = None, beam: int = BEAM) -> DataFrame:
    """(id, score) of the nearest k of each block that its walk finds. `allowed` (id) are the points that a filter leaves."""
    spark = graph.sparkSession
    importable(spark)
    query = np.array(vector, float)
    if allowed is None:
        rows = graph.select("ids", "vectors", "links", "pivots", F.lit(None).cast("array<string>").alias("allowed"))
    else:  # each block's own: no more than its points
        place = graph.select("block", F.explode("ids").alias("id"))
        own = place.join(allowed.select(F.col("id").cast("string").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi").groupBy(F.col("block").alias("_block")).agg(F.collect_list("id").alias("allowed"))
        rows = graph.join(own, F.col("block") == F.col("_block")).select("ids", "vectors", "links", "pivots", "allowed")

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                ids, vectors, links, pivots, some = (b.column(c)[i].as_py() for c in range(5))
                v = np.frombuffer(vectors, np.float32).reshape(len(ids), -1)
                at, scores = np.zeros(0, int), np.zeros(0)
                if v.shape[1] == len(query) and np.linalg.norm(query) > 0:
                    norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                    mask = None if some is None else _mask(ids, some)
                    at, scores = walk(v, norms, np.frombuffer(links, np.int32).reshape(len(ids), -1), np.frombuffer(pivots, np.int32), query, k, mask, beam)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in at.tolist()], pa.string()), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, "id string, score double")


def _mask(ids: Sequence[str], some: Sequence[str]) -> np.ndarray:
    wanted = set(some)
    return np.fromiter((i in wanted for i in ids), bool, len(ids))


def top_k(graph: DataFrame, points: DataFrame, vector: Sequence[float], k: int, filters: Mapping[str, Any] | None = None, column: str = "vector", id_col: str = "id") -> DataFrame:
    """As `search.top_k`, by the graph of these points; exactly where the filter leaves fewer points in the graph than are asked for."""
    from lectern.operators import search as exact

    live = exact.where_all(points, filters or {})
    allowed = live.select(F.col(f"`{id_col}`").alias("id")) if filters else None
    found = search(graph, vector, k, allowed).orderBy(F.desc("score"), "id").limit(k).collect()  # k rows
    if len(found) < k:
        return exact.top_k(points, vector, k, filters, column, id_col)
    few = live.where(F.col(f"`{id_col}`").cast("string").isin([r["id"] for r in found]))
    return exact.top_k(few, vector, k, None, column, id_col)
