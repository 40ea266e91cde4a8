"""Centroid clustering of integer vectors by a progressive search in the Walsh-Hadamard domain.

Components become integers, floor(scale * x). The Walsh-Hadamard transform of a vector is exact in integers, and squared
distances of transforms are the dimension times those of the vectors. Its coefficients, ordered by sign changes, hold the
coarse shape first. The search adds up squared coefficient differences to all centroids over the coarsest coefficients,
finishes the centroid that is ahead there, and goes on coarse to fine with those that are not strictly worse than the best
finished distance; survivors have been through all coefficients, so their distances are exact and ties are kept.

Transforms are computed once and written to the shared folder, 256 bytes a vector. A round is one pass: tasks send sums of
components by cluster (a few hundred integers a task), which are added by cluster and component. Vectors are never
shuffled, so neither repeated vectors nor large clusters gather anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm import common as c

LONG = 1 << 63
#: Coefficients up to here leave room for 64 squared differences in 64 bits.
NARROW = 1 << 26
LIMB = 40


@dataclass(frozen=True)
class Settings:
    """size must be a power of two; a step ends at each of `stops` coefficients."""

    clusters: int = 8
    rounds: int = 10
    size: int = 64
    scale: int = 1024
    seed: str = "3"
    stops: tuple[int, ...] = (4, 16, 32, 64)


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, coefficients in order of their sign changes; integers of any kind."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x[:, coarse_to_fine(size)]


def coarse_to_fine(size: int) -> np.ndarray:
    """Numbers of the natural order, by the sign changes of their functions."""
    i = np.arange(size)
    signs = np.array([[bin(a & b).count("1") & 1 for a in i] for b in i])
    return np.argsort(np.abs(np.diff(signs, axis=1)).sum(axis=1), kind="stable")


def nearest(vectors: np.ndarray, centroids: np.ndarray, stops: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """For transformed vectors the nearest centroid (ties: the smaller number), the sum over all coefficients, and how
    many coefficient differences were taken."""
    n, k = len(vectors), len(centroids)
    rows, first = np.arange(n), stops[0]

    def add(row: np.ndarray, number: int, low: int, high: int) -> np.ndarray:
        d = vectors[row, low:high] - centroids[number, low:high]
        return (d * d).sum(axis=1)

    sums = np.empty((n, k), vectors.dtype)
    for i in range(k):
        sums[:, i] = add(rows, i, 0, first)
    taken = n * k * first
    ahead = np.argmin(sums, axis=1)
    best = sums[rows, ahead]
    for i in range(k):
        own = np.flatnonzero(ahead == i)
        best[own] += add(own, i, first, stops[-1])
    taken += n * (stops[-1] - first)
    alive = sums <= best[:, None]
    alive[rows, ahead] = False
    for low, high in zip(stops, stops[1:]):
        for i in range(k):
            left = np.flatnonzero(alive[:, i])
            sums[left, i] += add(left, i, low, high)
            alive[left, i] = sums[left, i] <= best[left]
            taken += len(left) * (high - low)
    sums[rows, ahead] = best
    alive[rows, ahead] = True
    # What is alive has been through all coefficients; the first smallest of them wins.
    choice, least = np.full(n, -1), best.copy()
    for i in range(k):
        better = alive[:, i] & ((choice < 0) | (sums[:, i] < least))
        choice[better], least[better] = i, sums[better, i]
    return choice, least, taken


def integers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of finite doubles, exactly, also where the product leaves the range of doubles."""
    return [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.tolist()]


def pack_vectors(x: np.ndarray, scale: int) -> list[bytes]:
    """Transforms of a batch as 32-bit integers; a vector with larger ones is kept as its doubles."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    narrow = np.abs(whole).max(axis=1, initial=0) * x.shape[1] <= NARROW
    out: list[bytes] = [b""] * len(x)
    made = transform(whole[narrow].astype(np.int64)).astype("<i4")
    for i, row in zip(np.flatnonzero(narrow).tolist(), made):
        out[i] = row.tobytes()
    for i in np.flatnonzero(~narrow).tolist():
        out[i] = x[i].astype("<f8").tobytes()
    return out


@dataclass
class Centroids:
    """Integer centroids and their transforms."""

    points: list[list[int]]
    settings: Settings
    narrow: bool = field(init=False)
    transformed: np.ndarray = field(init=False)

    def __post_init__(self):
        wide = np.array(self.points, dtype=object).reshape(len(self.points), self.settings.size)
        largest = max((abs(v) for p in self.points for v in p), default=0)
        self.narrow = largest * self.settings.size <= NARROW
        self.transformed = transform(wide.astype(np.int64) if self.narrow else wide)

    def assign(self, packed: list[bytes]) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Clusters and squared distances; 64-bit integers where everything is narrow, else integers of any size."""
        s = self.settings
        cluster, distance = np.zeros(len(packed), np.int64), np.zeros(len(packed), object)
        small = [i for i, b in enumerate(packed) if len(b) == 4 * s.size]
        large = [i for i, b in enumerate(packed) if len(b) != 4 * s.size]
        if small:
            x = unpack(packed, small, s.size)
            centres = self.transformed
            if not self.narrow:
                x = x.astype(object)
            cluster[small], sums, _ = nearest(x, centres, s.stops)
            distance[small] = sums // s.size
        if large:
            x = transform(np.array([integers(np.frombuffer(packed[i], "<f8"), s.scale) for i in large], dtype=object))
            cluster[large], sums, _ = nearest(x, self.transformed.astype(object), s.stops)
            distance[large] = sums // s.size
        return cluster, distance


def unpack(packed: list[bytes], which: list[int], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed[i] for i in which), "<i4").reshape(-1, size).astype(np.int64)


def limbs(value: int) -> list[tuple[int, int]]:
    """(place, digits): the integer in signed places of LIMB bits, so that places add up in 64 bits."""
    sign, value, place, out = (-1 if value < 0 else 1), abs(value), 0, []
    while value:
        out.append((place, sign * (value & ((1 << LIMB) - 1))))
        value >>= LIMB
        place += 1
    return out


def sums_by_cluster(packed: DataFrame, centroids: Centroids, components: bool) -> dict[tuple[int, int], int]:
    """(cluster, i) -> sum of the transforms' coefficient i; i = size counts vectors and size + 1 sums distances."""
    s = centroids.settings

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if not rows:
                continue
            cluster, distance = centroids.assign(rows)
            small = np.array([len(b) == 4 * s.size for b in rows])
            for k in np.unique(cluster).tolist():
                own = np.flatnonzero(cluster == k)
                found = {s.size: len(own), s.size + 1: int(distance[own].sum())}
                if components:
                    narrow, wide = own[small[own]].tolist(), own[~small[own]].tolist()
                    if narrow:
                        found |= dict(enumerate(unpack(rows, narrow, s.size).sum(axis=0).tolist()))
                    for i in wide:
                        row = transform(np.array([integers(np.frombuffer(rows[i], "<f8"), s.scale)], dtype=object))[0]
                        for j, v in enumerate(row.tolist()):
                            found[j] = found.get(j, 0) + v
                for j, v in found.items():
                    total[k, j] = total.get((k, j), 0) + v
        out = [(k, j, place, digits) for (k, j), v in total.items() for place, digits in limbs(v)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "i", "place", "digits"],
        )

    parts = packed.select("vector").mapInArrow(run, "cluster int, i int, place int, digits bigint")
    total = parts.groupBy("cluster", "i", "place").agg(F.sum(F.col("digits").cast("decimal(20,0)")).alias("digits"))
    out: dict[tuple[int, int], int] = {}
    for r in total.collect():  # clusters * (size + 2) sums, whatever the number of vectors
        out[r.cluster, r.i] = out.get((r.cluster, r.i), 0) + (int(r.digits) << (LIMB * r.place))
    return out


def kept(vectors: DataFrame, vec_id: str, embedding: str, size: int) -> DataFrame:
    """(vec_id, x): vectors with exactly `size` components, none null, infinite or not a number."""
    out = vectors.select(c.quoted(vec_id).alias("vec_id"), c.quoted(embedding).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return out.where((F.size("x") == size) & fine)


def first_centroids(rows: DataFrame, s: Settings) -> list[list[int]]:
    """The vectors with the smallest hash of seed and id; rows that share an id by their components, a null id last."""
    digest = F.sha2(F.concat(F.lit(s.seed + ":"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(s.clusters)
    return [integers(np.array(r.x), s.scale) for r in chosen.collect()]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (decimal integers) for every vector kept.

    Vectors that are null, of another length, or hold a null, infinite or undefined component are left out. Repeated rows
    are vectors of their own; a null id is kept and never among the first centroids while others are left. With fewer
    vectors than clusters there are as many centroids as vectors, and an empty table gives no rows. Distances are exact
    for components of any size; a distance or inertia that no 64-bit integer holds is null.
    """
    s, spark = settings, vectors.sparkSession
    rows = kept(vectors, vec_id, embedding, s.size)
    points = first_centroids(rows, s)
    if not points:
        columns = "cast(null as int) cluster, 0L distance, 0L cluster_inertia, 0L inertia, array('') centroid"
        return rows.limit(0).selectExpr("vec_id", *columns.split(", "))

    def encode(columns: list[pa.Array]) -> list[pa.Array]:
        x = columns[0].flatten().to_numpy(zero_copy_only=False).reshape(-1, s.size)
        return [pa.array(pack_vectors(x, s.scale), pa.binary())]

    packed = c.stored(c.with_arrow_columns(rows, ["x"], {"vector": "binary"}, encode).drop("x"), "transforms")
    # The transform is its own inverse up to the size, so sums of vectors follow from sums of transforms.
    place = np.argsort(coarse_to_fine(s.size))
    for _ in range(s.rounds):
        total = sums_by_cluster(packed, Centroids(points, s), True)
        for k in range(len(points)):
            if n := total.get((k, s.size), 0):
                coefficients = np.array([[total.get((k, j), 0) for j in range(s.size)]], dtype=object)[:, place]
                natural = transform(coefficients)[0][place]
                points[k] = [int(v) // s.size // n for v in natural]
    last = Centroids(points, s)
    total = sums_by_cluster(packed, last, False)
    inertia = {k: total.get((k, s.size + 1), 0) for k in range(len(points))}
    whole = sum(inertia.values())

    def fitting(values) -> pa.Array:
        return pa.array([v if v < LONG else None for v in map(int, values)], pa.int64())

    def finish(columns: list[pa.Array]) -> list[pa.Array]:
        found, distance = last.assign(columns[0].to_pylist())
        return [pa.array(found, pa.int32()), fitting(distance)]

    out = c.with_arrow_columns(packed, ["vector"], {"cluster": "int", "distance": "bigint"}, finish).drop("vector")
    facts = [(k, inertia[k] if inertia[k] < LONG else None, whole if whole < LONG else None, [str(v) for v in p]) for k, p in enumerate(points)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<string>")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
