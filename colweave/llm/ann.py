"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced bisections of a bounded sample. Every vector is indexed in the list of its nearest centroid,
and boundary vectors in those of a few almost as near. A query walks a neighbour graph of the centroids, which every task
holds in memory, and takes the lists whose centroids are within a ratio of the nearest one's distance, and a few nearest
ones in any case; their vectors are compared exactly. The walk starts from centroids spread over all of them, since
clusters that lie apart are not linked by the graph. Queries whose lists hold too few ids take further lists, until they have enough or all. Lists above a
size are split into parts, so copies of one vector do not meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm.common import quoted, starts_of, stored, with_arrow_columns


@dataclass(frozen=True)
class Settings:
    """sample bounds the vectors that fit the centroids, lists the centroids; both are broadcast or collected.

    near: neighbours of a query. replicas, replica_ratio: lists of a vector and how far they may be, against the nearest.
    search_ratio: the same for a query's lists. least_lists: lists of a query at least. degree: edges of a centroid.
    entries: centroids from which a walk starts. part_rows: vectors or queries of one task's meeting. seed decides the
    bisections.
    """

    sample: int = 20_000
    lists: int = 4096
    list_rows: int = 256
    near: int = 5
    replicas: int = 3
    replica_ratio: float = 1.02
    search_ratio: float = 1.2
    least_lists: int = 24
    degree: int = 24
    entries: int = 256
    part_rows: int = 2000
    seed: int = 11


@dataclass
class Index:
    dimension: int
    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1, so that no square leaves the range of doubles.

    Scaling by a power of two rounds nothing, so cosines are those of the vectors as they are.
    """
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame, embedding: str, dimension: int | None = None) -> DataFrame:
    """Vectors that take part: not null, no null or non-finite component, not all zero, of the index's dimension."""
    v = quoted(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(v, lambda x: x.cast("double") != 0)
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return rows.where(F.size(v) == dimension) if dimension else rows


def bisect(vectors: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of `lists` (about) equally large clusters: halves at the median along the line between two means."""
    rng = np.random.default_rng(seed)
    clusters = [np.arange(len(vectors))]
    while len(clusters) < lists and max(map(len, clusters)) > 1:
        clusters.sort(key=len)
        own = clusters.pop()
        points = vectors[own]
        ends = points[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            along = points @ (ends[0] - ends[1])
            high = np.zeros(len(own), bool)
            high[np.argsort(along, kind="stable")[len(own) // 2 :]] = True
            ends = np.stack([points[high].mean(axis=0), points[~high].mean(axis=0)])
        clusters += [own[high], own[~high]]
    return np.stack([vectors[i].mean(axis=0) for i in clusters])


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * vectors @ centroids.T
    return np.sqrt(np.maximum(square, 0.0))


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> Index | None:
    """The index for the most frequent dimension (of several, the smallest); None if no vector can take part."""
    s, rows = settings, usable(vectors, embedding)
    sizes = rows.groupBy(F.size(quoted(embedding)).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    dimension, n = sizes["d"], sizes["count"]
    share = min(1.0, s.sample / n)
    hashed = F.pmod(F.xxhash64(quoted(vec_id), quoted(embedding)), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = usable(vectors, embedding, dimension).where(hashed).select(quoted(vec_id).alias("i"), quoted(embedding).alias("v")).toArrow()
    if not picked.num_rows:
        picked = usable(vectors, embedding, dimension).select(quoted(vec_id).alias("i"), quoted(embedding).alias("v")).limit(1).toArrow()
    sample = np.array(picked["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
    sample = unit(sample[np.lexsort((*sample.T, picked["i"].to_numpy()))])
    centroids = np.unique(bisect(sample, max(1, min(s.lists, n // s.list_rows)), s.seed), axis=0)
    between = distances(centroids, centroids)
    edges = np.argsort(between, axis=1, kind="stable")[:, 1 : s.degree + 1]
    return Index(dimension, centroids, edges, spread(centroids, s.entries))


def spread(centroids: np.ndarray, most: int) -> np.ndarray:
    """The most central centroid, then each time the one farthest from all taken so far; so no far cluster is left out."""
    taken = [int(np.argmin(distances(centroids, centroids.mean(axis=0, keepdims=True))))]
    away = ((centroids - centroids[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < min(most, len(centroids)):
        taken.append(int(np.argmax(away)))
        away = np.minimum(away, ((centroids - centroids[taken[-1]]) ** 2).sum(axis=1))
        away[taken] = -1.0
    return np.array(taken)


def walk(index: Index, query: np.ndarray, ratio: float, least: int) -> list[int]:
    """Lists whose centroids are within `ratio` of the nearest centroid's distance, and the `least` nearest found, by
    best-first search of the graph."""

    def measure(nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(((index.centroids[nodes] - query) ** 2).sum(axis=1))

    seen = np.zeros(len(index.centroids), bool)
    seen[index.entries] = True
    heap = sorted(zip(measure(index.entries).tolist(), index.entries.tolist()))
    found, best = [], heap[0][0]
    tries = 0
    while heap:
        d, node = heapq.heappop(heap)
        # A few steps beyond the ratio lead over gaps of the graph.
        tries = tries + 1 if d > ratio * best and len(found) >= least else 0
        if tries > 16:
            break
        found.append((d, node))
        near = index.edges[node]
        near = near[~seen[near]]
        seen[near] = True
        for e, m in zip(measure(near).tolist(), near.tolist()):
            best = min(best, e)
            heapq.heappush(heap, (e, m))
    return [node for k, (d, node) in enumerate(sorted(found)) if k < least or d <= ratio * best]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, row by row, so equal vectors get equal values."""
    vectors, query = scaled(vectors), scaled(query[None])[0]
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(vectors: DataFrame, queries: DataFrame, index: Index | None, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each query, its own id left out.

    Vectors and queries that are null, zero, of another dimension, or with null or non-finite components take no part.
    Ties go to the smaller id; rows that share an id count once, with the nearest of their vectors. A query has fewer than
    `near` neighbours only if the table has no more ids.
    """
    s, spark = settings, vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(index)
    rows = usable(vectors, embedding, index.dimension).select(quoted(vec_id).cast("bigint").alias("id"), quoted(embedding).alias("v")).where("id is not null")
    asked = usable(queries, embedding, index.dimension).select(quoted(vec_id).cast("bigint").alias("id"), quoted(embedding).alias("v")).where("id is not null")

    def assign(columns: list[pa.Array]) -> list[pa.Array]:
        d = distances(unit(_matrix(columns[0], held.value.dimension)), held.value.centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, : s.replicas]
        near = np.take_along_axis(d, order, axis=1)
        keep = near <= s.replica_ratio * near[:, :1]
        return [pa.array([o[k].tolist() for o, k in zip(order, keep)], pa.list_(pa.int32()))]

    def route(columns: list[pa.Array]) -> list[pa.Array]:
        found = [walk(held.value, q, s.search_ratio, s.least_lists) for q in unit(_matrix(columns[0], held.value.dimension))]
        return [pa.array(found, pa.list_(pa.int32()))]

    def nearest(lists: int) -> Callable[[list[pa.Array]], list[pa.Array]]:
        def take(columns: list[pa.Array]) -> list[pa.Array]:
            order = np.argsort(distances(unit(_matrix(columns[0], held.value.dimension)), held.value.centroids), axis=1, kind="stable")
            return [pa.array(order[:, :lists].tolist(), pa.list_(pa.int32()))]

        return take

    posted = with_arrow_columns(rows, ["v"], {"lists": "array<int>"}, assign).select("id", "v", F.explode("lists").alias("list"))

    def meet(table: pa.Table, query_table: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if table.num_rows and query_table.num_rows:
            dimension = held.value.dimension
            own, asking = _matrix(table["v"], dimension), _matrix(query_table["v"], dimension)
            ids = table["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            own, ids = own[order], ids[order]
            begins = starts_of(ids)
            distinct, copies = ids[begins], np.diff(np.append(begins, len(ids)))
            close = unit(own) @ unit(asking).T
            for k, q in enumerate(query_table["id"].to_numpy()):
                others = distinct != q
                if not others.any():
                    continue
                # The bound is that of the best row of each id, so copies of an id do not take the places of others.
                near = np.maximum.reduceat(close[:, k], begins)
                least = np.partition(near[others], -s.near)[-s.near] - 1e-9 if others.sum() > s.near else -np.inf
                rows_near = np.flatnonzero(np.repeat(others, copies) & (close[:, k] >= least))
                exact = cosines(own[rows_near], asking[k])
                starts = starts_of(ids[rows_near])
                found_ids, exact = ids[rows_near][starts], np.maximum.reduceat(exact, starts)
                best = np.lexsort((found_ids, -exact))[: s.near]
                out_q += [q] * len(best)
                out_v += found_ids[best].tolist()
                out_s += exact[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    def met(asked: DataFrame, router: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
        """(query_id, vec_id, score) of the lists that the router gives each query."""
        routed = with_arrow_columns(asked, ["v"], {"lists": "array<int>"}, router).select("id", "v", F.explode("lists").alias("list"))
        # Both sides of a large list are cut into parts; every part of the one meets every part of the other.
        parts = posted.groupBy("list").agg(F.ceil(F.count("*") / s.part_rows).cast("int").alias("parts"))
        parts = parts.join(routed.groupBy("list").agg(F.ceil(F.count("*") / s.part_rows).cast("int").alias("sides")), "list")

        def placed(frame: DataFrame, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int").alias(own)
            both = frame.join(parts, "list").select("id", "v", "list", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
            return both.select("id", "v", "list", "parts", "sides")

        keys = ("list", "parts", "sides")
        both = placed(posted, "parts", "sides").groupBy(*keys).cogroup(placed(routed, "sides", "parts").groupBy(*keys))
        return both.applyInArrow(meet, "query_id bigint, vec_id bigint, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return stored(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= s.near), "neighbours")

    result, reach, lists = ranked(met(asked, route)), 1, len(index.centroids)
    while reach < lists:
        full = result.groupBy("query_id").count().where(F.col("count") >= s.near).select(F.col("query_id").alias("id"))
        short = asked.join(full, "id", "left_anti")
        if short.isEmpty():
            break
        reach = min(8 * reach, lists)
        result = ranked(result.drop("rank").unionByName(met(short, nearest(reach))))
    return result.select("query_id", "rank", "vec_id", "score")
