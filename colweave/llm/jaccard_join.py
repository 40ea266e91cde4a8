"""Exact Jaccard self-join of documents on word n-grams by count vectors and R-trees.

A document is the set of its distinct word n-grams. The n-grams are hashed into groups; the counts of the groups are the
document's point, and two sets overlap in no more n-grams than the sum of their smaller counts. The join goes from coarse
to fine:

1. Equal texts are one class, which its smallest id stands for.
2. Cells: sets of which less than the threshold occurs in any other set fall away. In the others the rarest n-grams, as
   many as a similar set may lack and one more, are cells; similar sets meet in one.
3. Families: documents connected over cells. No link leaves a family.
4. Within a family an R-tree over coarse points (64 groups) is searched for each document: a node is pruned if the sum of
   coordinate minima against its upper corner cannot reach the overlap that its sizes need. Pairs that survive are
   verified on their sets, unless earlier links connect them already.

Families above a size are first thinned by stars: members are verified against a centre, round by round; then only members
of different stars meet, in pairs of bounded chunks. Nothing is dropped: every pair over the threshold is either verified or
connected by verified links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm import common as c

U64 = np.uint64
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """The threshold is numerator / 100. family_rows and chunk_rows bound the documents that meet in one task."""

    shingle: int = 5
    percent: int = 80
    groups: int = 64
    family_rows: int = 400
    chunk_rows: int = 200
    star_rounds: int = 6


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, U64)
    if len(words) < n:
        return c.mix(c.rolling(words, len(words)) + U64(len(words)))
    return np.unique(c.rolling(words, n))


def cell_keys(found: np.ndarray, ranks: np.ndarray, s: Settings) -> np.ndarray:
    """The rarest n-grams, one more than a set may lack of the overlap: sets above the threshold share one of them.

    All sets are ordered alike, by the rank of their n-grams' frequency and then by hash.
    """
    size = len(found)
    most = size - -(-size * s.percent // 100) + 1
    first = np.lexsort((found, ranks))[:most]
    return found[first[ranks[first] > 0]]


class Tree:
    """A packed R-tree over points with sizes: leaves of neighbouring points, then nodes of neighbouring leaves."""

    FAN = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = np.lexsort((points @ np.arange(points.shape[1]), sizes))
        self.levels = []
        high, low, top = points[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1:
            cuts = np.arange(0, len(high), self.FAN)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((high, low, top))

    def search(self, q: int, percent: int) -> np.ndarray:
        """Other points, later in the tree's order than q's, whose bound on the overlap reaches the threshold."""
        point, size = self.points[q], int(self.sizes[q])

        def within(high, low, top):
            need = percent * (size + low)
            fits = (low * percent <= size * 100) & (top * 100 >= size * percent)
            return fits & (np.minimum(point, high).sum(axis=1) * (100 + percent) >= need)

        nodes = np.zeros(1, np.int64)
        for level, (high, low, top) in enumerate(reversed(self.levels)):
            if level:
                nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                nodes = nodes[nodes < len(high)]
            nodes = nodes[within(high[nodes], low[nodes], top[nodes])]
        if self.levels:
            nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        found = self.order[nodes[nodes < len(self.order)]]
        return found[within(self.points[found], self.sizes[found], self.sizes[found])]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_within(ids: np.ndarray, stars: np.ndarray, sets: list[np.ndarray], s: Settings) -> list[tuple[int, int]]:
    """Verified links that connect whatever links of the group connect; members of one star count as connected."""
    sizes = np.array([len(x) for x in sets], np.int64)
    points = np.stack([np.bincount((x >> U64(58)).astype(np.int64) % s.groups, minlength=s.groups) for x in sets])
    tree = Tree(points, sizes)
    _, root = np.unique(stars, return_inverse=True)
    found = [(q, tree.search(q, s.percent)) for q in range(len(ids))]
    a = np.concatenate([np.full(len(x), q) for q, x in found])
    b = np.concatenate([x for _, x in found])
    a, b = a[a < b], b[a < b]
    bound = np.concatenate([np.minimum(points[i], points[j]).sum(axis=1) for i, j in zip(np.array_split(a, len(a) // 4096 + 1), np.array_split(b, len(a) // 4096 + 1))])
    order = np.argsort(-(bound / (sizes[a] + sizes[b])), kind="stable")
    a, b = a[order], b[order]
    links = []
    while len(a):
        for i, j in zip(a[:256].tolist(), b[:256].tolist()):
            if root[i] != root[j] and similar(sets[i], sets[j], s.percent):
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
        a, b = a[256:], b[256:]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return links


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; other columns are left to the caller to join.

    Null texts and texts without words have no n-grams and are linked with nothing, as are rows without an id (whose
    component is null). Rows that share an id are one node to the links of all their texts.
    """
    s = settings
    digest = F.unhex(F.md5(F.coalesce(c.quoted(text), F.lit("")).cast("binary")))
    slim = c.stored(docs.select(c.quoted(doc_id).cast("bigint").alias("id"), digest.alias("digest")), "digests")
    # Equal texts are one class, which its smallest id stands for; texts without n-grams are none.
    measured, links = _links(docs, doc_id, text, digest, slim.groupBy("digest").agg(F.min("id").alias("id")), s)
    copies = slim.where("id is not null").join(measured.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    ids = slim.where("id is not null").select("id").distinct()
    final = c.components(ids, links.union(copies), "components").withColumnRenamed("component", "component_id")
    out = slim.join(measured.select("digest", "n_shingles"), "digest", "left").join(final, "id", "left")
    return out.select(F.col("id").alias(doc_id), F.coalesce("n_shingles", F.lit(0)).cast("bigint").alias("n_shingles"), "component_id")


def _links(docs: DataFrame, doc_id: str, text: str, digest: Column, classes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(digest, id, n_shingles) of the classes with n-grams; (a, b): verified links that connect all that links connect."""
    blocks = c.block_count(docs, text, BLOCK_BYTES)
    base = docs.select(c.quoted(doc_id).cast("bigint").alias("id"), c.quoted(text).alias("text"), digest.alias("digest"))
    block = c.block_of([F.col("id"), F.col("digest")], blocks)
    base = base.withColumn("block", block)
    chosen = classes.select(block, "id", "digest", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("flags"))

    def sets_of(table: pa.Table, side: pa.Table) -> list[tuple[int | None, bytes, np.ndarray]]:
        """(id, digest, set) of the block's classes that have n-grams; a class without an id is only measured."""
        wanted = set(zip(side["id"].to_pylist(), side["digest"].to_pylist()))
        known, out = c.WordHashes(), []
        for i, d, t in zip(table["id"].to_pylist(), table["digest"].to_pylist(), table["text"]):
            if (i, d) in wanted:
                wanted.discard((i, d))
                found = shingle_set(known.of(c.words(t.as_py(), lower=True)), s.shingle)
                if len(found):
                    out.append((i, d, found))
        return out

    def keys_of(own: list[tuple[int | None, bytes, np.ndarray]]) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *(x for i, _, x in own if i is not None)])

    def ask(table: pa.Table, side: pa.Table) -> pa.Table:
        block = (table if table.num_rows else side)["block"][0].as_py()
        return c.pieces_of(block, keys_of(sets_of(table, side)), blocks, c.FILTER_BYTES)

    def survivors(table: pa.Table, side: pa.Table) -> pa.Table:
        """The size of every set, and the sets of which so many n-grams occur elsewhere that another may be similar."""
        asked = side["shard"].is_valid()
        own = sets_of(table, side.filter(pa.compute.invert(asked)))
        again = c.answered(keys_of(own), side.filter(asked), blocks)
        sets, at = [], 0
        for i, _, x in own:
            held = int(again[at : at + len(x)].sum()) if i is not None else 0
            at += len(x) if i is not None else 0
            sets.append(x.tobytes() if 100 * held >= s.percent * len(x) else None)
        return pa.table(
            {
                "id": pa.array([i for i, _, _ in own], pa.int64()),
                "digest": pa.array([d for _, d, _ in own], pa.binary()),
                "n_shingles": pa.array([len(x) for _, _, x in own], pa.int64()),
                "shingles": pa.array(sets, pa.binary()),
            }
        )

    by_block = base.groupBy("block")
    answers = c.repeated_keys(by_block.cogroup(chosen.groupBy("block")).applyInArrow(ask, c.PIECES), c.FILTER_BYTES)
    nothing = (F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("digest"))
    both = chosen.unionByName(answers.select("block", *nothing, "shard", "flags"))
    measured = c.stored(by_block.cogroup(both.groupBy("block")).applyInArrow(survivors, "id bigint, digest binary, n_shingles bigint, shingles binary"), "sets")
    sets = measured.where("shingles is not null").select("id", "shingles")
    cells = c.stored(_cells(sets, s), "cells")
    centre = cells.groupBy("cell").agg(F.min("id").alias("centre"))
    meet = cells.join(centre, "cell").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    families = c.components(sets.select("id"), meet, "families").withColumnRenamed("component", "family")
    families = c.stored(families, "families")
    sizes = families.groupBy("family").count().where("count > 1")
    small = families.join(sizes.where(F.col("count") <= s.family_rows).select("family"), "family")
    large = families.join(sizes.where(F.col("count") > s.family_rows).select("family"), "family")
    grouped = small.join(sets, "id").select("family", "id", F.col("id").alias("star"), "shingles")
    links = _searched(grouped, ["family"], s)
    if not large.isEmpty():
        links = links.union(_large_families(large, sets, s))
    return measured.select("digest", "id", "n_shingles"), c.stored(links, "links")


def _cells(sets: DataFrame, s: Settings) -> DataFrame:
    """(cell, id) for the cells of every set."""
    blocks = c.block_count(sets, "shingles")
    by_block = sets.withColumn("block", c.block_of([F.col("id")], blocks)).groupBy("block")

    def arrays(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]]

    def ask(table: pa.Table) -> pa.Table:
        return c.pieces_of(table["block"][0].as_py(), np.concatenate(arrays(table)), blocks, c.FILTER_BYTES)

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = arrays(table)
        ranks = c.answered(np.concatenate(own), answers, blocks, bits=False)
        keys = [cell_keys(x, r, s) for x, r in zip(own, np.split(ranks, np.cumsum([len(x) for x in own])[:-1]))]
        ids = np.repeat(table["id"].to_numpy(), [len(k) for k in keys])
        return pa.table({"cell": pa.array(np.concatenate(keys).view(np.int64)), "id": pa.array(ids, pa.int64())})

    answers = c.key_ranks(by_block.applyInArrow(ask, c.PIECES), c.FILTER_BYTES)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(place, "cell bigint, id bigint")


def _searched(grouped: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    def search(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]]
        links = links_within(table["id"].to_numpy(), table["star"].to_numpy(), sets, s) if len(sets) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return grouped.groupBy(*keys).applyInArrow(search, "a bigint, b bigint")


def _large_families(large: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Stars round by round, then pairs of chunks of different stars."""

    def verified(columns: list[pa.Array]) -> list[pa.Array]:
        pairs = zip(*([np.frombuffer(x.as_buffer(), U64) for x in column] for column in columns))
        return [pa.array([similar(a, b, s.percent) for a, b in pairs], pa.bool_())]

    sets = c.stored(sets.join(large.select("id"), "id", "left_semi"), "large-sets")
    open_, n_open = large.select("family", "id"), large.count()
    stars = []
    for _ in range(s.star_rounds):
        centre = open_.groupBy("family").agg(F.min("id").alias("star"), F.count("*").alias("n")).where(F.col("n") > s.chunk_rows)
        centre = centre.select("family", "star").join(sets.select(F.col("id").alias("star"), F.col("shingles").alias("of_star")), "star")
        tested = open_.join(centre, "family", "left").join(sets, "id")
        tested = c.with_arrow_columns(tested.where("star is not null"), ["shingles", "of_star"], {"linked": "boolean"}, verified, rows=256)
        tested = c.stored(tested.select("family", "id", "star", "linked"), "stars")
        if tested.isEmpty():
            break
        stars.append(tested.where("linked").select("family", "id", "star"))
        open_ = c.stored(open_.join(stars[-1].select("id"), "id", "left_anti").select("family", "id"), "open")
        before, n_open = n_open, open_.count()
        if n_open > 0.9 * before:
            break
    # Members without a star have the core NONE; a piece is (core, chunk).
    none = F.lit(-(1 << 63)).cast("bigint")
    members = c.union_all([*[x.withColumn("core", F.col("star")) for x in stars], open_.select("family", "id", F.col("id").alias("star"), none.alias("core"))])
    sizes = members.groupBy("family", "core").agg(F.ceil(F.count("*") / s.chunk_rows).cast("int").alias("chunks"))
    pieces = sizes.select("family", F.col("core"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    pieces = pieces.select("family", F.struct("core", "chunk").alias("piece"))
    one, two = pieces.toDF("family", "piece_1"), pieces.toDF("family", "piece_2")
    apart = (F.col("piece_1.core") != F.col("piece_2.core")) | (F.col("piece_1.core") == none)
    ordered = (F.col("piece_1") < F.col("piece_2")) | ((F.col("piece_1") == F.col("piece_2")) & (F.col("piece_1.core") == none))
    meets = one.join(two, "family").where(apart & ordered).withColumn("meeting", F.xxhash64("family", "piece_1", "piece_2"))
    ends = meets.select("family", "meeting", F.explode(F.array_distinct(F.array("piece_1", "piece_2"))).alias("piece"))
    placed = members.join(sizes, ["family", "core"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = placed.select("family", "id", "star", F.struct("core", "chunk").alias("piece"))
    grouped = placed.join(ends, ["family", "piece"]).join(sets, "id").select("family", "meeting", "id", "star", "shingles")
    within = c.union_all([x.select(F.col("star").alias("a"), F.col("id").alias("b")) for x in stars]) if stars else None
    links = _searched(grouped, ["family", "meeting"], s)
    return links.union(within) if within is not None else links
