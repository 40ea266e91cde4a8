"""Helpers shared by the operators: words, held-out rows, blocks of documents, and questions put to shards of keys.

Blocks and shards are the two sides of the global lookups. A block is a bounded share of the documents (by a hash of id
and text); a shard is a bounded share of all keys (by a hash of the key). Each block sends its distinct keys to the shards, a
shard sees every holder of its keys, and the answers go back to the blocks. Keys are distinct within a block before they
travel, so one frequent key costs a shard at most one entry for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.session import shared_folder

BLOCK_BYTES = 16 << 20
U64 = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, as UTF-8."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def fold(doc_id: str, parts: int) -> Column:
    """The remainder of the id's CRC that decides whether a row is held out; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


FILTER_BYTES = 4


class WordHashes(dict):
    """Word -> 64-bit hash, computed once for each distinct word of a task."""

    LIMIT = 1_000_000

    def __init__(self, seed: int = 0):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.seed, self.digest = seed, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.digest(word, self.seed)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), U64, len(found))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64, at least n of them."""
    have = _POWERS.get(factor)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        inverse = pow(factor, -1, 1 << 64)
        up, down = np.full(size, factor, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        have = _POWERS[factor] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(factor, len(values))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up, dtype=U64)])
    return mix((total[width:] - total[:-width]) * down[:n])


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks keep each near `block_bytes` of text; more than the cores of the session, so all have work."""
    size = docs.agg(F.sum(F.octet_length(quoted(text)).cast("bigint") + 64)).first()[0] or 0
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // block_bytes))


def block_of(columns: list[Column], blocks: int) -> Column:
    """The block of a row; by id and text (or its digest), so rows without an id or sharing one are spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int").alias("block")


def _packed(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of every key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data, width: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :width] = part
    return full.view("<u8").ravel()


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys; a shard owns a range of the hashes' upper half."""
    limits = (np.arange(1, shards, dtype=U64) << U64(32)) // U64(shards)
    cuts = np.concatenate([[0], np.searchsorted(keys >> U64(32), limits), [len(keys)]])
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


PIECES = "block int, shard int, keys binary, counts binary"


def pieces_of(block: int, keys: np.ndarray, shards: int, width: int = 8) -> pa.Table:
    """The keys of one block, which may repeat, as distinct keys with counts for each shard.

    With a width below 8, keys of a shard that agree in their low bytes are taken for one: enough to filter by.
    """
    keys = np.sort(keys)
    begins = starts_of(keys)
    every, counts = keys[begins], np.diff(np.append(begins, len(keys)))
    split = by_shard(every, shards)
    return pa.table(
        {
            "block": pa.array([block] * len(split), pa.int32()),
            "shard": pa.array([s for s, _, _ in split], pa.int32()),
            "keys": pa.array([_packed(every[a:b], width) for _, a, b in split], pa.binary()),
            "counts": pa.array([np.minimum(counts[a:b], 255).astype(np.uint8).tobytes() for _, a, b in split], pa.binary()),
        }
    )


def _held(table: pa.Table, width: int) -> tuple[np.ndarray, list[int]]:
    """How often each key of a shard's pieces occurs in all of them, and where the pieces end."""
    parts = [_unpacked(x.as_buffer(), width) for x in table["keys"]]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["counts"]])
    every = np.concatenate(parts)
    order = np.argsort(every)
    begins = starts_of(every[order])
    total = np.add.reduceat(counts[order].astype(np.int64), begins)
    held = np.empty(len(every), np.int64)
    held[order] = np.repeat(total, np.diff(np.append(begins, len(every))))
    return held, np.cumsum([len(p) for p in parts])[:-1].tolist()


def repeated_keys(pieces: DataFrame, width: int = 8) -> DataFrame:
    """Pieces -> (block, shard, flags): packed bits, in the order of the keys, of those that occur at least twice."""

    def merge(table: pa.Table) -> pa.Table:
        held, cuts = _held(table, width)
        packed = [np.packbits(x > 1).tobytes() for x in np.split(held, cuts)]
        return pa.table({"block": table["block"], "shard": table["shard"], "flags": pa.array(packed, pa.binary())})

    return pieces.groupBy("shard").applyInArrow(merge, "block int, shard int, flags binary")


def key_ranks(pieces: DataFrame, width: int = 8) -> DataFrame:
    """Pieces -> (block, shard, flags): a byte for each key that grows with the logarithm of its occurrences, 0 for one."""

    def merge(table: pa.Table) -> pa.Table:
        held, cuts = _held(table, width)
        rank = np.minimum(255, np.ceil(6 * np.log2(held))).astype(np.uint8)
        return pa.table({"block": table["block"], "shard": table["shard"], "flags": pa.array([x.tobytes() for x in np.split(rank, cuts)], pa.binary())})

    return pieces.groupBy("shard").applyInArrow(merge, "block int, shard int, flags binary")


def answered(keys: np.ndarray, answers: pa.Table, shards: int, bits: bool = True) -> np.ndarray:
    """For each of the block's keys (which may repeat) what its shard says: a flag, or with bits=False its byte."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = starts_of(ordered)
    every = ordered[begins]
    out = np.zeros(len(every), bool if bits else np.uint8)
    got = dict(zip(answers["shard"].to_pylist(), answers["flags"]))
    for shard, a, b in by_shard(every, shards):
        data = np.frombuffer(got[shard].as_buffer(), np.uint8)
        out[a:b] = np.unpackbits(data, count=b - a).view(bool) if bits else data
    result = np.empty(len(keys), out.dtype)
    result[order] = np.repeat(out, np.diff(np.append(begins, len(keys))))
    return result


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_arrow_columns(
    docs: DataFrame, inputs: list[str], outputs: dict[str, str], compute: Callable[[list[pa.Array]], list[pa.Array]], rows: int = 4096
) -> DataFrame:
    """All columns, then `outputs` (name -> type) computed from `inputs` in Arrow batches of bounded rows.

    Columns that already have the name of an output (in any case) are replaced. Other names may hold any character.
    """
    taken = {name.lower() for name in outputs}
    names = [c for c in docs.columns if c.lower() not in taken]
    plain = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], *[quoted(c).alias(f"i{i}") for i, c in enumerate(inputs)])
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    fields += [T.StructField(f"o{i}", T._parse_datatype_string(t)) for i, t in enumerate(outputs.values())]
    n = len(names)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = compute(batch.columns[n:])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[f.name for f in fields])

    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, *outputs)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: later steps neither repeat its work nor its lineage."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every node id, where component is the smallest id reachable over links (a, b).

    Alternates large-star and small-star steps: each node's neighbours are attached to the smallest of them until nothing
    changes, which takes a number of rounds logarithmic in the longest chain. Every step is a shuffle of the links with
    partial minima; a hot node costs a join whose skewed keys adaptive execution splits, never a gathered list.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = stored(pairs.distinct(), name)
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        same = pairs.join(after, ["a", "b"], "left_anti").isEmpty() and after.join(pairs, ["a", "b"], "left_anti").isEmpty()
        pairs = after
        if same:
            break
    roots = pairs.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["id"] == roots["a"], "left").select(nodes["id"], F.coalesce("component", "id").alias("component"))
