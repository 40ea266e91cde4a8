"""Packing documents into sequences by non-negative least squares on the histogram of lengths.

Every document is cut into full windows and one rest. Shallow combinations of rest lengths (two or three) that fill a
window exactly are enumerated, their repeat counts are the non-negative least squares solution against the histogram of
rests, rounded down. What is left is packed greedily, longest first; where nothing fits a gap, one document is cut to fill
it, so only the last sequence is padded.

The plan is made from the histogram alone, which has one entry for each length below the window. Documents find their place
by their rank among the documents of the same length; ranks are counted in buckets, so a length that a third of all
documents share is spread like any other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm import common as c
from colweave.llm.tokens import encoder


@dataclass(frozen=True)
class Settings:
    """max_patterns bounds the combinations tried; a plan of more than broadcast_rows rows is joined without a hint."""

    window: int = 2048
    end_id: int = 1
    max_patterns: int = 24_000
    steps: int = 400
    broadcast_rows: int = 200_000
    bucket_docs: int = 20_000


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def combinations(present: np.ndarray, window: int, most: int) -> list[tuple[int, ...]]:
    """Two or three of the present lengths that sum to the window; triples are spread evenly if there are too many."""
    held = set(present.tolist())
    pairs = [(a, window - a) for a in present.tolist() if a <= window - a and window - a in held]
    room = max(0, most - len(pairs))
    each = max(1, room // max(1, len(held)))
    triples = []
    for a in sorted(held):
        own = [(a, b, window - a - b) for b in sorted(x for x in held if x >= a) if window - a - b >= b and window - a - b in held]
        step = max(1, -(-len(own) // each))
        triples += own[a % step :: step]
    return pairs + triples[:room]


def least_squares(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the packed lengths from the histogram."""
    if not patterns:
        return np.zeros(0)
    row = np.array([i for p in patterns for i in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    size, n = len(histogram), len(patterns)
    v = np.ones(n)
    for _ in range(30):
        v = np.bincount(col, np.bincount(row, v[col], size)[row], n)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        slope = np.bincount(col, (np.bincount(row, y[col], size) - histogram)[row], n)
        after = np.maximum(0.0, y - slope / (norm * 1.05))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


@dataclass
class Plan:
    """rows: (length, first rank, end rank, start in the rest, piece length, first sequence, offset)."""

    rows: list[tuple[int, int, int, int, int, int, int]]
    sequences: int
    padding: int
    solved: int  # sequences that follow the least squares solution


def make_plan(counts: dict[int, int], s: Settings) -> Plan:
    """Places for all rests; counts: length (1 to window - 1) -> documents with such a rest."""
    left = np.zeros(s.window + 1, np.int64)
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(s.window + 1)]  # rest, first rank, documents, start
    for size, n in counts.items():
        left[size] = n
        runs[size].append((size, 0, n, 0))
    rows, sequences = [], 0

    def take(size: int, repeat: int) -> list[tuple[int, int, int, int]]:
        left[size] -= repeat
        taken = []
        while repeat:
            rest, rank, n, start = runs[size].pop()
            if n > repeat:
                runs[size].append((rest, rank + repeat, n - repeat, start))
                n = repeat
            taken.append((rest, rank, n, start))
            repeat -= n
        return taken

    def place(sizes: list[int], repeat: int, cut: int = 0, room: int = 0) -> None:
        """`repeat` sequences of pieces of these lengths; the last `room` ids come from rests of length `cut`."""
        nonlocal sequences
        offset = 0
        for size, piece in [(i, i) for i in sizes] + [(cut, room)] * bool(cut):
            done = sequences
            for rest, rank, n, start in take(size, repeat):
                rows.append((rest, rank, rank + n, start, piece, done, offset))
                done += n
                if piece < size:
                    runs[size - piece].append((rest, rank, n, start + piece))
                    left[size - piece] += n
            offset += piece
        sequences += repeat

    patterns = combinations(np.flatnonzero(left), s.window, s.max_patterns)
    wish = np.floor(least_squares(patterns, left.astype(float), s.steps) + 1e-6).astype(np.int64)
    for k in np.argsort(-wish, kind="stable").tolist():
        parts = patterns[k]
        repeat = min(int(wish[k]), *(int(left[p]) // parts.count(p) for p in parts))
        if repeat > 0:
            place(list(parts), repeat)
    solved, padding = sequences, 0

    while left.any():
        need = np.zeros(s.window + 1, np.int64)
        fill, room = [], s.window
        while room and (fit := np.flatnonzero(left[: room + 1] > need[: room + 1])).size:
            fill.append(int(fit[-1]))
            need[fill[-1]] += 1
            room -= fill[-1]
        cut = int(np.flatnonzero(left > need)[-1]) if room and (left > need).any() else 0
        need[cut] += bool(cut)
        wanted = np.flatnonzero(need)
        repeat = int((left[wanted] // need[wanted]).min())
        if room and not cut and (s.window - room) & (s.window - room - 1):
            padding += repeat * room
        place(fill, repeat, cut, room)
    return Plan(rows, sequences, padding, solved)


MEASURED = {"doc_tokens": "bigint", "text_hash": "bigint", "crcs": "array<bigint>"}


def measure(docs: DataFrame, tokenizer: str, text: str, s: Settings) -> DataFrame:
    """Adds doc_tokens, text_hash and the CRC of every full window and of the rest."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encode = encoder(tokenizer)
        sizes, crcs = [], []
        for t in columns[0].to_pylist():
            ids = np.append(encode(t or ""), np.uint32(s.end_id))
            sizes.append(len(ids))
            crcs.append([crc(ids[i : i + s.window]) for i in range(0, len(ids), s.window)])
        return [pa.array(sizes, pa.int64()), columns[1], pa.array(crcs, pa.list_(pa.int64()))]

    with_hash = docs.withColumn("text_hash", F.xxhash64(F.coalesce(c.quoted(text), F.lit(""))))
    return c.with_arrow_columns(with_hash, [text, "text_hash"], MEASURED, run, rows=512)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one: its only id is the end id. Rows are documents, also if they share an id. An empty table
    gives no rows. Sequences shorter than the window are padded to it, except at a power of two.
    """
    s, spark = settings, docs.sparkSession
    slim = docs.select(c.quoted(doc_id).alias("doc_id"), c.quoted(text).alias("text"))
    sized = measure(slim, tokenizer, "text", s).drop("text")
    sized = c.stored(sized.withColumn("rest", (F.col("doc_tokens") % s.window).cast("int")), "lengths")
    counts = {r["rest"]: r["count"] for r in sized.groupBy("rest").count().collect()}
    plan = make_plan({k: n for k, n in counts.items() if k}, s)
    buckets = max(64, sum(counts.values()) // s.bucket_docs)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).cast("int"))
    order = ("doc_id", "text_hash")

    # Full windows are sequences of their own, numbered after the planned ones.
    before = F.sum(F.size("crcs") - (F.col("rest") > 0).cast("int")).over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    full = sized.where(F.col("doc_tokens") >= s.window).withColumn("before", F.coalesce(before, F.lit(0)))
    full = full.select("*", F.posexplode(F.slice("crcs", F.lit(1), (F.col("doc_tokens") / s.window).cast("int"))).alias("k", "ids_crc32"))
    full = full.select(
        "doc_id",
        (F.col("k") * s.window).cast("bigint").alias("start"),
        F.lit(s.window).cast("bigint").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(plan.sequences) + (F.col("before") + F.col("k")) * buckets + F.col("bucket")).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )

    rests = sized.where("rest > 0").select("doc_id", "text_hash", "doc_tokens", "rest", "bucket", F.element_at("crcs", -1).alias("whole_crc"))
    per_bucket = rests.groupBy("rest", "bucket").count()
    base = F.sum("count").over(Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per_bucket = per_bucket.select("rest", "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy(*order))
    ranked = rests.withColumn("local", local).join(per_bucket, ["rest", "bucket"]).withColumn("rank", F.col("base") + F.col("local") - 1)
    places = spark.createDataFrame(plan.rows or [(0, 0, 0, 0, 0, 0, 0)], "size int, low bigint, high bigint, part int, piece int, sequence bigint, offset bigint")
    if len(plan.rows) <= s.broadcast_rows:
        places = F.broadcast(places)
    placed = ranked.join(places, (F.col("rest") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select(
        "doc_id",
        "text_hash",
        (F.col("doc_tokens") - F.col("rest") + F.col("part")).alias("start"),
        F.col("piece").cast("bigint").alias("length"),
        F.when(F.col("piece") == F.col("rest"), F.col("whole_crc")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("ids_crc32 is not null").select(columns)
    cut = placed.where("ids_crc32 is null")
    return full.unionByName(whole).unionByName(_cut_pieces(cut, slim, tokenizer, s).select(columns))


def _cut_pieces(cut: DataFrame, docs: DataFrame, tokenizer: str, s: Settings) -> DataFrame:
    """The pieces of cut documents with their CRC: only these documents are encoded again."""
    keyed = docs.select(F.col("doc_id").alias("other_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("other_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    keys = cut.select("doc_id", "text_hash").distinct()
    texts = keyed.join(keys, same, "left_semi").dropDuplicates(["other_id", "other_hash"])
    joined = cut.join(texts, same).drop("other_id", "other_hash", "ids_crc32")

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encode = encoder(tokenizer)
        out = []
        for t, start, length in zip(*(x.to_pylist() for x in columns)):
            ids = np.append(encode(t or ""), np.uint32(s.end_id))
            out.append(crc(ids[start : start + length]))
        return [pa.array(out, pa.int64())]

    return c.with_arrow_columns(joined, ["text", "start", "length"], {"ids_crc32": "bigint"}, run, rows=512)
