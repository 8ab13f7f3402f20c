"""Approximate nearest neighbours: inverted file with product-quantised residuals (operator 10).

Coarse centroids and residual codebooks are fitted by k-means on a bounded sample;
every vector is indexed. A query visits lists, estimates its inner products with their members
by asymmetric distance tables (query against codewords) and scores exactly, on the original vectors
in double precision, those members that can be among its nearest.

What is passed over is passed over by bounds, so the answer is exact whatever the vectors are: an inner product differs from that with the
centroid by at most the query's length times the member's distance from the centroid, and from the estimate by at most the query's length
times what quantising left of the member. Both are held against a floor under the query's k nearest, first from the sample, then from the
portion itself. Vectors in clusters lie in few lists that pass; vectors without clusters, like those of the test tables, in most.

Equal vectors are one class: whatever the query, they tie, and ties go to the smaller
id, so of a class only its k + 1 smallest ids can ever be returned. The index is a table of
classes in the order of their lists, cut into portions of some PORTION classes wherever a list ends, so a crowded
list is many tasks. Queries come in blocks of bounded size, which are broadcast to a scan of the index;
vectors are never copied or shuffled for a query.

With probe_share a query visits that share of the lists only, and with a shortlist so many members of a portion are scored: then the search is
approximate, and how much of the truth it finds depends on the vectors.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm._spark import Scope, cut, session_for_texts

K = 20
SAMPLE = 20_000  # vectors that centroids and codebooks are fitted on
MOST_LISTS = 1024
LEAST_PROBES = 16  # lists that a query visits at least where probe_share limits them
SUBSPACES = 16
CODEWORDS = 256
PORTION = 8192  # classes that are looked at together
BLOCK_BYTES = 16 << 20  # of the queries that are broadcast at a time, and of their products with the centroids
FLOOR_BYTES = 8 << 20  # of the sample's vectors that give queries their floor
ROUNDING = 1e-9  # more than sums of products can be off, as a share of the lengths' product


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.RandomState) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=k)
            centres[:, d] = np.where(n > 0, total / np.maximum(n, 1), centres[:, d])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _parts(x: np.ndarray, m: int, w: int) -> np.ndarray:
    """Vectors in m parts of w components, the last one filled up with zeros."""
    return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)


@dataclass
class Index:
    """Coarse centroids (lists x d) and residual codebooks (subspaces x codewords x width)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 11) -> Index:
        rng = np.random.RandomState(seed)
        x = sample.astype(np.float64)
        centroids = _kmeans(x, min(lists, len(x)), 12, rng)
        residual = x - centroids[_nearest(x, centroids)]
        w = -(-x.shape[1] // SUBSPACES)
        m = -(-x.shape[1] // w)
        parts = _parts(residual, m, w)
        books = np.stack([_kmeans(parts[:, j], min(CODEWORDS, len(x)), 8, rng) for j in range(m)])
        return cls(centroids, books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and residual codes of each vector."""
        near = _nearest(x, self.centroids)
        m, _, w = self.codebooks.shape
        parts = _parts(x - self.centroids[near], m, w)
        return near, np.stack([_nearest(np.ascontiguousarray(parts[:, j]), self.codebooks[j]) for j in range(m)], 1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What is known of vectors from their lists and codes."""
        residual = np.concatenate([self.codebooks[j][codes[:, j]] for j in range(len(self.codebooks))], 1)
        return self.centroids[lists] + residual[:, : self.dimension]

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centroids have the largest inner product with each query."""
        s = q @ self.centroids.T
        n = min(n, s.shape[1])
        return np.argpartition(-s, n - 1, 1)[:, :n]

    def asymmetric(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products, queries x vectors, from one table for each query and subspace."""
        m, _, w = self.codebooks.shape
        tables = np.einsum("qjw,jkw->jqk", _parts(q, m, w), self.codebooks)
        out = (q @ self.centroids.T)[:, lists]
        for j in range(m):
            out += tables[j][:, codes[:, j]]
        return out


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): vectors as arrays of DOUBLE that are not null, empty or zero and hold finite numbers only."""
    v = df[f"`{vector}`"].cast("array<double>")
    body = df.select(df[f"`{id_col}`"].alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return body.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, probe_share: float | None = None, least_probes: int = LEAST_PROBES, shortlist: int | None = None, most_lists: int = MOST_LISTS) -> DataFrame:
    """Each query's k nearest among all other rows by inner product: query_id, rank, the id, score. None is missed, unless probe_share or a shortlist limits the search.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty, zero,
    hold null or non-finite components, or have another length than most, take no part; rows
    with a null id neither. Ids may be of any type with an order. Rows of one id are one neighbour, by the nearest of
    their vectors, and never their own; as a query an id asks with the least of its vectors. Other columns are not
    read. An empty table gives no rows.
    """
    with Scope() as scope:
        return scope.keep(_search(vectors, queries, id_col, vector, k, probe_share, least_probes, shortlist, most_lists))


def _search(vectors, queries, id_col, vector, k, probe_share, least_probes, shortlist, most_lists) -> DataFrame:
    spark = vectors.sparkSession
    session_for_texts(spark)
    kind, id_type = vectors.schema[id_col].dataType.simpleString(), to_arrow_type(vectors.schema[id_col].dataType)
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    good = usable(vectors, id_col, vector)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return empty
    d = sizes[0]["d"]
    good = good.where(F.size("v") == d)
    # Classes of equal vectors with their k + 1 smallest ids, gathered in two steps so that no class meets in one task whole.
    salted = good.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("_r", F.dense_rank().over(Window.partitionBy("v", "_s").orderBy("id"))).where(F.col("_r") <= k + 1).distinct()
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")))
    n = classes.count()
    sample = classes.orderBy("h", "v").limit(SAMPLE).select("v", F.col("ids")[0].alias("id")).toArrow()
    lists = int(min(most_lists, max(1, round(math.sqrt(n)))))
    index = Index.fit(_matrix(sample.column(0), d), lists)
    lists = len(index.centroids)
    probes = lists if probe_share is None else min(lists, max(least_probes, math.ceil(probe_share * lists)))
    packed = pickle.dumps(index)
    # Rows of different ids: k + 1 of them are k neighbours at least, whichever id asks. A limited search may find none as near, so it has no floor.
    lone = _matrix(sample.column("v"), d)[_lone(sample.column("id").to_pylist())][: FLOOR_BYTES // (d * 8)] if probes == lists and shortlist is None else np.zeros((0, d))

    def assign(batches):
        ix = pickle.loads(packed)
        for b in batches:
            near, codes = ix.encode(_matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "h", "list", "codes"])

    members = classes.select("v", "ids", "h").mapInArrow(assign, f"v array<double>, ids array<{kind}>, h bigint, list int, codes binary")
    members = cut(members.repartitionByRange(max(1, math.ceil(n / PORTION)), "list", "h").sortWithinPartitions("list", "h"))
    asked = usable(queries, id_col, vector).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    asked = cut(asked.withColumn("h", F.xxhash64("v")))
    blocks = max(1, math.ceil(asked.count() * (d + lists) * 8 / BLOCK_BYTES))

    def floors(batches):
        for b in batches:
            q = _matrix(b.column(0), d)
            with np.errstate(all="ignore"):
                floor = _next_best(q @ lone.T - ROUNDING * _length(q)[:, None] * _length(lone), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], ["v", "h", "key", "floor"])

    # Equal queries are answered together; a block is read by itself and holds about BLOCK_BYTES.
    distinct = asked.groupBy("v", "h").agg(F.min("id").alias("key")).select("v", "h", "key").mapInArrow(floors, f"v array<double>, h bigint, key {kind}, floor double")
    distinct = cut(distinct.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")), "block")
    found = [cut(_visited(members, distinct.where(F.col("block") == i), packed, d, k, kind, id_type, probes, shortlist)) for i in range(blocks)]
    every = reduce(DataFrame.unionByName, found)
    # An id in several classes counts with its nearest.
    one = every.groupBy("key", "id").agg(F.max("score").alias("score"))
    best = one.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k + 1)
    best = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "score"))).alias("near"))
    best = best.join(distinct.select("key", F.col("v").alias("_v"), F.col("h").alias("_h")), "key")
    answered = asked.select(F.col("id").alias("query_id"), "v", "h").join(best, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")))
    kept = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    rows = answered.select("query_id", F.posexplode(kept).alias("_p", "x"))
    return rows.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("x")["id"].alias(id_col), F.col("x")["score"].alias("score"))


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _lone(ids: list) -> np.ndarray:
    """The first place of each id."""
    return np.array(sorted({x: i for i, x in reversed(list(enumerate(ids)))}.values()), int)


def _next_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the score of rank k + 1; -inf where there are fewer."""
    if scores.shape[1] <= k:
        return np.full(len(scores), -np.inf)
    return np.partition(np.where(np.isnan(scores), -np.inf, scores), -k - 1, 1)[:, -k - 1]


def _visited(members: DataFrame, queries: DataFrame, packed: bytes, d: int, k: int, kind: str, id_type, probes: int, shortlist: int | None) -> DataFrame:
    """(key, id, score): of each portion of the index the k + 1 ids nearest to each query of a block, as far as they can be among its k + 1 nearest of all."""
    block = queries.select("key", "v", "floor").toArrow()
    asked, keys, floor = _matrix(block.column("v"), d).copy(), block.column("key").to_pylist(), block.column("floor").to_numpy()

    def portion(ix, x, ids, lists, codes):
        out_q, out_id, out_s = [], [], []
        present, place = np.unique(lists, return_inverse=True)
        far, left = _length(x - ix.centroids[lists]), _length(x - ix.decode(lists, codes))
        rounding = ROUNDING * (_length(x) + 2 * far + left)
        reach = np.zeros(len(present))
        np.maximum.at(reach, place, far + rounding)
        lone = np.zeros(len(x), bool)
        lone[_lone([i[0] for i in ids])] = True
        coarse = asked @ ix.centroids.T
        size = _length(asked)
        visits = ~(coarse[:, present] + size[:, None] * reach < floor[:, None])
        if probes < len(ix.centroids):
            near = np.zeros(coarse.shape, bool)
            np.put_along_axis(near, ix.probes(asked, probes), True, 1)
            visits &= near[:, present]
        some = np.flatnonzero(visits.any(1))
        some = some[np.argsort(coarse[some].argmax(1), kind="stable")]  # those that visit the same lists together
        for at in range(0, len(some), 128):
            rows = some[at : at + 128]
            own = np.flatnonzero(visits[rows].any(0)[place])
            q, v, only = asked[rows], x[own], lone[own]
            seen = visits[rows][:, place[own]]
            estimate = np.where(seen, ix.asymmetric(q, lists[own], codes[own]), -np.inf)
            slack = size[rows][:, None] * (left + rounding)[own]
            least = np.fmax(floor[rows], _next_best((estimate - slack)[:, only], k))
            able = seen & ~(estimate + slack < least[:, None])
            if shortlist and len(own) > shortlist:
                short = np.zeros(able.shape, bool)
                np.put_along_axis(short, np.argpartition(-estimate, shortlist - 1, 1)[:, :shortlist], True, 1)
                able &= short
            left_over = np.flatnonzero(able.any(0))
            own, v, only, able = own[left_over], v[left_over], only[left_over], able[:, left_over]
            # Products narrow it down to the k + 1 best and what is within rounding of them; what counts is each one's own sum.
            slack = size[rows][:, None] * rounding[own]
            products = np.where(able, q @ v.T, -np.inf)
            least = np.fmax(least, _next_best((products - slack)[:, only], k))
            able &= ~(products + slack < least[:, None])
            for i in range(len(q)):
                best = own[able[i]]
                exact = (x[best] * q[i]).sum(1)
                got: dict = {}
                last = None  # the score after which no class can add an id
                for j in np.argsort(-exact, kind="stable").tolist():
                    if last is not None and exact[j] < last:
                        break
                    for y in ids[best[j]]:
                        got.setdefault(y, exact[j])
                    if last is None and len(got) > k:
                        last = exact[j]
                for y, score in sorted(got.items(), key=lambda r: (-r[1], r[0]))[: k + 1]:
                    out_q.append(keys[rows[i]])
                    out_id.append(y)
                    out_s.append(score)
        return pa.RecordBatch.from_arrays([pa.array(out_q, id_type), pa.array(out_id, id_type), pa.array(out_s, pa.float64())], ["key", "id", "score"])

    def run(batches):
        ix = pickle.loads(packed)
        held, n = [], 0
        with np.errstate(all="ignore"):  # a comparison with what is no number leaves nothing out
            for b in batches:
                held.append(b)
                n += len(b)
                if n >= PORTION:
                    yield portion(ix, *columns(held))
                    held, n = [], 0
            if n:
                yield portion(ix, *columns(held))

    def columns(held):
        t = pa.Table.from_batches(held)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(t), -1)
        return _matrix(t.column("v"), d), t.column("ids").to_pylist(), t.column("list").to_numpy(), codes

    return members.select("v", "ids", "list", "codes").mapInArrow(run, f"key {kind}, id {kind}, score double")
