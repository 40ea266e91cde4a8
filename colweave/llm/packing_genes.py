"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a set of bins; a bin is the list of lengths it holds. Documents of one length are interchangeable, so equal
bins are one gene with a count, and a solution has a bounded number of genes whatever the number of documents: it is made
from the histogram of lengths, which has at most one entry for each length up to the window.

Crossover injects whole well-filled bins of one parent into the other, takes away the other's bins that hold what was
injected (worst filled first), exchanges documents of bins with gaps for longer displaced ones, and places the rest, longest
first, into the tightest gaps. Mutation does the same with badly filled bins and a few others. Every island evolves its own population in a task of its own; between epochs
each island's best solution moves on to the next island. Islands stop at the least number of bins that any packing needs.

Documents find their place by their rank among the documents of their length, counted in buckets of row numbers, so a
length, an id or a text that a third of all rows share is spread like any other.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.llm import common as c
from colweave.llm.tokens import encoder

Bins = dict[tuple[int, ...], int]


@dataclass(frozen=True)
class Settings:
    """A solution of more than most_genes genes is not kept, which bounds what is sent; best fit alone stays far below."""

    window: int = 2048
    end_id: int = 0
    islands: int = 4
    epochs: int = 3
    population: int = 6
    children: int = 18
    most_genes: int = 40_000
    seed: int = 11
    bucket_docs: int = 50_000


# ---- solutions ------------------------------------------------------------------------------------------------------


def best_fit(bins: Bins, lengths: Iterable[tuple[int, int]], window: int) -> Bins:
    """Places (length, documents) in the order given, each document into the tightest gap that holds it."""
    done: Counter = Counter()
    gaps: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(window + 1)]
    open_gaps = 0  # one bit for each gap that some bin has
    for held, n in bins.items():
        gap = window - sum(held)
        gaps[gap].append((held, n))
        open_gaps |= 1 << gap
    for length, n in lengths:
        while n:
            fitting = open_gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                held, have = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps ^= 1 << gap
            else:
                gap, held, have = window, (), n
            # A bin that took one document is the tightest for the next, until it is full.
            each = gap // length
            full = min(have, n // each)
            if full:
                _open(gaps, held + (length,) * each, full, gap - each * length)
                open_gaps |= 1 << (gap - each * length)
                n -= full * each
                have -= full
            if have and n and n < each:
                _open(gaps, held + (length,) * n, 1, gap - n * length)
                open_gaps |= 1 << (gap - n * length)
                n, have = 0, have - 1
            if have and held:
                _open(gaps, held, have, gap)
                open_gaps |= 1 << gap
    for some in gaps:
        for held, n in some:
            done[tuple(sorted(held, reverse=True))] += n
    return dict(done)


def _open(gaps: list, held: tuple[int, ...], n: int, gap: int) -> None:
    gaps[gap].append((held, n))


def bins_of(solution: Bins) -> int:
    return sum(solution.values())


def fitness(solution: Bins, window: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, those that fill some bins well and leave the slack to few."""
    return -bins_of(solution), sum(n * (sum(held) / window) ** 2 for held, n in solution.items())


def least_bins(counts: dict[int, int], window: int) -> int:
    """No packing has fewer bins: by volume, and by documents of which no two share a bin, with what cannot join them.

    For every length `small` up to half the window: documents longer than window - small are alone among those of at
    least `small`, those above half the window share a bin with no other such, and what is left fills their gaps at best.
    """
    n = np.zeros(window + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    volume = n * np.arange(window + 1)
    many, much = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(volume))  # of all shorter lengths
    half = window // 2
    best = -(-int(much[-1]) // window)
    for small in range(half + 1):
        high = window - small + 1
        large, halves = many[-1] - many[high], many[high] - many[half + 1]
        gap = halves * window - (much[high] - much[half + 1])
        best = max(best, int(large + halves + max(0, -(-(much[half + 1] - much[small] - gap) // window))))
    return best


def _share(rng: random.Random, n: int, share: float) -> int:
    """About this share of n things, in whole ones."""
    exact = n * share
    return int(exact) + (rng.random() < exact - int(exact))


def crossover(rng: random.Random, mother: Bins, father: Bins, window: int) -> Bins:
    """The mother with whole well-filled bins of the father."""
    fills = sorted(map(sum, father), reverse=True)
    least = fills[min(len(fills) - 1, int(len(fills) * rng.uniform(0.3, 0.9)))]
    share = rng.uniform(0.2, 0.8)
    injected = {held: k for held, n in father.items() if sum(held) >= least and (k := _share(rng, n, share))}
    again: Counter = Counter()
    for held, n in injected.items():
        for length in held:
            again[length] += n
    return _without(rng, mother, injected, again, window)


def _without(rng: random.Random, bins: Bins, injected: Bins, again: Counter, window: int) -> Bins:
    """`injected` with those of `bins` that do not hold documents it has, and the rest of the displaced bins placed anew."""
    out: Counter = Counter(injected)
    for held, n in sorted(bins.items(), key=lambda x: (sum(x[0]), x[0])):
        take = 0
        for length in set(held):
            if again[length] > 0:
                take = max(take, min(n, -(-again[length] // held.count(length))))
        if take:
            for length in held:
                again[length] -= take
        if n > take:
            out[held] += n - take
    loose = Counter({length: -k for length, k in again.items() if k < 0})
    out = swap(rng, out, loose, window)
    return best_fit(out, _shaken(rng, loose, 0.0), window)


def mutate(rng: random.Random, bins: Bins, window: int) -> Bins:
    """Dissolves most of the worst filled bins and a few others; places their documents by best fit, nearly by length."""
    order = sorted(bins, key=lambda held: (sum(held), held))
    with_gaps = sum(sum(held) < window for held in order)
    worst = order[: max(1, int(with_gaps * rng.uniform(0.1, 1.0)))]
    others = rng.sample(order, max(1, int(len(order) * rng.uniform(0.0, 0.1))))
    kept, loose = dict(bins), Counter()
    for held in dict.fromkeys(worst + others):
        n = max(1, _share(rng, kept[held], rng.uniform(0.2, 1.0)))
        kept[held] -= n
        if not kept[held]:
            del kept[held]
        for length in held:
            loose[length] += n
    kept = swap(rng, kept, loose, window)
    return best_fit(kept, _shaken(rng, loose, rng.choice((0.0, 0.01, 0.05, 0.2))), window)


def swap(rng: random.Random, bins: Bins, loose: Counter, window: int) -> Bins:
    """Fills gaps by exchanging one or two documents of a bin for a longer loose one; shorter ones are easier to place."""
    free = sum(1 << length for length, n in loose.items() if n > 0)
    out: Counter = Counter()
    order = list(bins.items())
    rng.shuffle(order)
    for held, n in order:
        gap = window - sum(held)
        best = (0, ())
        if gap and free:
            sizes = sorted(set(held))
            for gone in [(x,) for x in sizes] + [(x, y) for x, y in zip(held, held[1:])]:
                low = sum(gone)
                fitting = (free & ((1 << (low + gap + 1)) - 1)) >> (low + 1)
                if fitting:
                    best = max(best, (fitting.bit_length(), gone))
        gain, gone = best
        if gain:
            taken = sum(gone) + gain
            k = min(n, loose[taken])
            rest = list(held)
            for x in gone:
                rest.remove(x)
                loose[x] += k
                free |= 1 << x
            loose[taken] -= k
            if not loose[taken]:
                free ^= 1 << taken
            out[tuple(sorted([*rest, taken], reverse=True))] += k
            n -= k
        if n:
            out[held] += n
    return dict(out)


def _shaken(rng: random.Random, counts: dict[int, int], noise: float) -> list[tuple[int, int]]:
    """Lengths from the longest, disturbed by a little."""
    return sorted(((k, n) for k, n in counts.items() if n), key=lambda x: (-x[0] * (1 + noise * rng.random()), x[0]))


def evolve(population: list[Bins], counts: dict[int, int], target: int, rng: random.Random, s: Settings) -> list[Bins]:
    """One epoch of one island; the best come first."""

    def ranked(solutions: list[Bins]) -> list[Bins]:
        once = {frozenset(x.items()): x for x in solutions if len(x) <= s.most_genes}
        return sorted(once.values(), key=lambda x: fitness(x, s.window), reverse=True)[: s.population]

    if not population:
        population = [best_fit({}, _shaken(rng, counts, noise), s.window) for noise in (0.0, 0.05, 0.2, 0.5)[: s.population]]
    population = ranked(population) or population[:1]
    for _ in range(s.children):
        if bins_of(population[0]) <= target:
            break
        # The better of two drawn parents, twice.
        mother, father = (population[min(rng.randrange(len(population)), rng.randrange(len(population)))] for _ in "mf")
        child = crossover(rng, mother, father, s.window)
        if rng.random() < 0.7 or mother is father:
            child = mutate(rng, child, s.window)
        population = ranked([*population, child])
    return population


def solve(spark: SparkSession, counts: dict[int, int], s: Settings) -> Bins:
    """The best solution of all islands."""
    if not counts:
        return {}
    target = least_bins(counts, s.window)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        island, epoch = int(key[0]), int(frame["epoch"].iloc[0])
        genes = [pickle.loads(g) for g in frame.sort_values("rank")["genes"] if g is not None]
        out = evolve(genes, counts, target, random.Random(f"{s.seed}:{island}:{epoch}"), s)
        rows = [(island, epoch + 1, i, bins_of(x), fitness(x, s.window)[1], pickle.dumps(x)) for i, x in enumerate(out)]
        return pd.DataFrame(rows, columns=["island", "epoch", "rank", "bins", "filled", "genes"])

    columns = "island int, epoch int, rank int, bins bigint, filled double, genes binary"
    state = spark.createDataFrame([(i, 0, 0, 0, 0.0, None) for i in range(s.islands)], columns)
    for epoch in range(s.epochs):
        if epoch:
            moved = state.where("rank = 0").withColumn("island", ((F.col("island") + 1) % s.islands).cast("int")).withColumn("rank", F.lit(s.population))
            state = state.unionByName(moved)
        dealt = state.repartitionByRange(s.islands, "island")
        state = c.stored(dealt.groupBy("island").applyInPandas(run, columns), "islands")
        best = state.orderBy("bins", F.desc("filled"), "island", "rank").select("bins", "genes").first()
        if best.bins <= target:
            break
    return pickle.loads(best.genes)


# ---- documents ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Places:
    """Where documents of each length go, by rank: parallel arrays in order of (length, first rank)."""

    length: np.ndarray
    first: np.ndarray  # rank of the first document of the entry
    each: np.ndarray  # documents of this length in a bin of the entry
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents by length and rank."""
        base = np.searchsorted(self.length, length)
        at = np.empty(len(length), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            low, high = base[own[0]], np.searchsorted(self.length, size, side="right")
            at[own] = low + np.searchsorted(self.first[low:high], rank[own], side="right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + (k % self.each[at]) * length


def places(bins: Bins) -> Places:
    used: Counter = Counter()
    rows, sequences = [], 0
    for held, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(held).items(), reverse=True):
            rows.append((length, used[length], each, sequences, offset))
            used[length] += n * each
            offset += length * each
        sequences += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Places(*columns, sequences)


def measure(docs: DataFrame, tokenizer: str, s: Settings) -> DataFrame:
    """Adds doc_tokens and the CRC of every piece."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encode = encoder(tokenizer)
        sizes, crcs = [], []
        for text in columns[0].to_pylist():
            raw = np.append(encode(text or ""), np.uint32(s.end_id)).astype("<u4").tobytes()
            sizes.append(len(raw) // 4)
            short = len(raw) % (4 * s.window)
            cuts = ([0] if short else []) + list(range(short, len(raw), 4 * s.window)) + [len(raw)]
            crcs.append([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])])
        return [pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]

    return c.with_arrow_columns(docs, ["text"], {"doc_tokens": "bigint", "crcs": "array<bigint>"}, run, rows=512)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than the window are cut, into windows; their first piece may be shorter. A null text is an empty
    one: its only id is the end id. Rows are documents, also if they share an id or are equal. An empty table gives no rows.
    """
    s, spark = settings, docs.sparkSession
    sized = measure(docs.select(c.quoted(doc_id).alias("doc_id"), c.quoted(text).alias("text")), tokenizer, s).drop("text")
    short = (F.col("doc_tokens") % s.window).cast("int")
    sized = c.stored(sized.withColumn("short", short).withColumn("row", F.monotonically_increasing_id()), "lengths")
    counts = {r["short"]: r["count"] for r in sized.groupBy("short").count().collect()}  # at most one for each length
    bins = solve(spark, {k: n for k, n in counts.items() if k}, s)
    plan = places(bins)
    buckets = max(64, sum(counts.values()) // s.bucket_docs)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))

    # Rank among the documents with a short piece of that length, and full windows before this row; both within a bucket.
    local = F.row_number().over(Window.partitionBy("bucket", "short").orderBy("row")) - 1
    windows = (F.col("doc_tokens") / s.window).cast("bigint")
    before = F.sum(windows).over(Window.partitionBy("bucket").orderBy("short", "row").rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("local", local).withColumn("before", F.coalesce(before, F.lit(0)))
    held = sized.groupBy("short", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")).count()
    base = F.sum("count").over(Window.partitionBy("short").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("short", "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    ranked = dealt.join(base, ["short", "bucket"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "row")

    def find(columns: list[pa.Array]) -> list[pa.Array]:
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in columns)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        own = length > 0
        if own.any():
            sequence[own], offset[own] = plan.find(length[own], rank[own])
        return [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]

    placed = c.with_arrow_columns(ranked, ["short", "rank"], {"sequence": "bigint", "place": "bigint"}, find)
    pieces = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    first = (F.col("short") > 0) & (F.col("piece") == 0)
    window = F.col("piece") - (F.col("short") > 0).cast("int")  # which full window
    own = F.lit(plan.sequences) + (F.col("before") + window) * buckets + F.col("bucket")
    return pieces.select(
        "doc_id",
        "piece",
        F.when(first, 0).otherwise(F.col("short") + window * s.window).cast("bigint").alias("start"),
        F.when(first, F.col("short")).otherwise(s.window).cast("bigint").alias("length"),
        "ids_crc32",
        F.when(first, F.col("sequence")).otherwise(own).cast("bigint").alias("sequence_id"),
        F.when(first, F.col("place")).otherwise(0).cast("bigint").alias("offset"),
    )
