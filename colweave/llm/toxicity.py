"""Toxicity by nearest labelled examples.

Documents are TF-IDF vectors over all words of the labelled examples. A word's weight is its inverse document frequency in
all documents, times a factor from a tenth to one that grows with how clearly the word goes with toxic examples. A
document's score is the vote of the examples with the largest cosine, each weighted by its distance, mapped to a probability
by an isotonic fit of the examples' own leave-one-out votes; the nearest examples are its evidence.

The nearest examples are found exactly in an inverted index. Postings of rare words are added up; for frequent ones, whose
postings are long, the index holds the largest weight in every block of similar examples, which bounds what they can add.
The blocks with the largest bounds are scored first, and then those whose bound reaches the k-th cosine found there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import quoted, with_arrow_columns

WORD = re.compile(r"\w+")
BATCH = 256


@dataclass(frozen=True)
class Settings:
    """What is learned from is bounded, as the index is broadcast: about so many toxic and clean examples, by a hash.

    near: distinct example vectors that vote. clear: square root of twice the log likelihood ratio at which a word has half
    of the full factor; least_factor: the factor of words that do not go with toxic examples. block: examples in a block;
    frequent: share of the examples that hold a frequent word; table_bytes bounds the table of their weights, beyond which
    words count as rare.
    """

    toxic_examples: int = 2_000
    clean_examples: int = 4_000
    near: int = 15
    clear: float = 4.0
    least_factor: float = 0.1
    block: int = 32
    frequent: float = 0.01
    table_bytes: int = 24 << 20
    softening: float = 0.05


def bag(text: str | None, terms: dict[str, int]) -> dict[int, int]:
    """Term -> occurrences, of the indexed words of a whole text."""
    if not text:
        return {}
    return Counter(terms[w] for w in WORD.findall(text.lower()) if w in terms)


def toxic_factors(toxic: np.ndarray, clean: np.ndarray, toxic_all: int, clean_all: int, s: Settings) -> np.ndarray:
    """least_factor to 1 for words held by so many toxic and clean examples of so many."""
    every, held = max(1, toxic_all + clean_all), toxic + clean

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    gain = sum(
        part(seen, of * share / every)
        for share, own in ((toxic_all, toxic), (clean_all, clean))
        for seen, of in ((own, held), (share - own, every - held))
    )
    clear = np.where(toxic * clean_all > clean * toxic_all, 2 * np.maximum(gain, 0.0), 0.0) ** 2
    return s.least_factor + (1 - s.least_factor) * clear / (clear + s.clear**4)


class Index:
    """Example vectors with block-max postings. Equal vectors are one entry with the number of its examples."""

    def __init__(self, terms: dict[str, int], weights: list[float], examples: Iterable[tuple[int, int, dict[int, int]]], s: Settings, clean_weight: float = 1.0):
        """weights: of the terms; clean_weight: labelled clean rows for each clean example, over the same for toxic ones."""
        self.s, self.terms, self.clean_weight = s, terms, clean_weight
        self.term_weight = np.asarray(weights, float)
        self.empty = [0, 0]  # toxic, all: examples without a word
        entries: dict[bytes, list] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        compact = []
        for doc_id, toxic, counts in examples:
            pairs = np.array([*counts.keys(), *counts.values()], np.int32).reshape(2, -1)
            compact.append((doc_id, toxic, pairs[:, np.argsort(pairs[0])]))
        for doc_id, toxic, pairs in sorted(compact, key=lambda e: e[0]):
            if not pairs.size:
                self.empty[0] += toxic
                self.empty[1] += 1
                continue
            entry = entries.setdefault(pairs.tobytes(), [0, 0, doc_id])
            if not entry[1]:
                held.append((pairs[0].astype(np.int64), pairs[1]))
            entry[0] += toxic
            entry[1] += 1
        del compact
        toxic, every = self.empty[0] + sum(e[0] for e in entries.values()), self.empty[1] + sum(e[1] for e in entries.values())
        self.rate = toxic / max(1.0, toxic + (every - toxic) * clean_weight)
        votes = list(entries.values())
        order = self._similar_first(held)
        self.votes = [votes[i] for i in order]
        vectors = [self._weighted(*held[i]) for i in order]
        self.first = np.cumsum([0, *(len(t) for t, _ in vectors)])
        self.term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        self.weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        self._post(np.repeat(np.arange(len(vectors)), np.diff(self.first)))
        self.knots: tuple[list[float], list[float]] = ([], [])

    def _post(self, entry: np.ndarray) -> None:
        """Postings of rare words, term by term; weights and block maxima of frequent ones as tables."""
        n, s = len(self.votes), self.s
        df = np.bincount(self.term, minlength=len(self.terms))
        most = s.table_bytes // (8 * max(1, n))
        frequent = np.argsort(-df, kind="stable")[: min(most, int((df > s.frequent * n).sum()))]
        self.column = np.full(len(self.terms), -1, np.int64)
        self.column[frequent] = np.arange(len(frequent))
        often = self.column[self.term] >= 0
        # Weights of frequent words: block, word, example of the block; the last block is filled up with empty examples.
        self.blocks = -(-n // s.block)
        self.table = np.zeros((self.blocks, len(frequent), s.block))
        self.table[entry[often] // s.block, self.column[self.term[often]], entry[often] % s.block] = self.weight[often]
        self.block_most = self.table.max(axis=2, initial=0.0).T.copy()
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.post_first = np.searchsorted(self.term[rare], np.arange(len(self.terms) + 1))
        self.post_entry, self.post_weight = entry[rare].astype(np.int32), self.weight[rare]

    def _similar_first(self, held: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
        """Examples in order of their heaviest word, if one stands out, and of their commonest ones."""
        common = np.argsort(np.argsort(-np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in held)]), minlength=len(self.terms)), kind="stable"))

        def key(i: int) -> tuple:
            terms = held[i][0]
            heavy = terms[np.argmax(self.term_weight[terms])]
            stands_out = self.term_weight[heavy] > 3 * np.median(self.term_weight[terms])
            return (int(common[heavy]) if stands_out else -1, *np.sort(common[terms])[:3].tolist())

        return sorted(range(len(held)), key=key)

    def _weighted(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(counts)) * self.term_weight[terms]
        norm = math.sqrt(float(raw @ raw))
        return terms, raw / norm if norm else raw

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        if not counts:
            return {}
        terms, weights = self._weighted(*(np.array(x, np.int64) for x in zip(*counts.items())))
        return dict(zip(terms.tolist(), weights.tolist()))

    @property
    def vectors(self) -> list[dict[int, float]]:
        return [dict(zip(self.term[a:b].tolist(), self.weight[a:b].tolist())) for a, b in zip(self.first, self.first[1:])]

    def nearest(self, vector: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, entry) of the k largest cosines above zero, exactly; ties go to the earlier entry."""
        if not vector:
            return []
        return self.nearest_of([(np.fromiter(vector.keys(), np.int64), np.fromiter(vector.values(), float))], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """`nearest` for (terms, weights) of several documents, whose frequent words are multiplied block by block."""
        if not self.blocks:
            return [[] for _ in queries]
        m, size, width = len(queries), self.s.block, self.blocks * self.s.block
        doc = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term, weight = (np.concatenate([np.zeros(0, kind), *(q[i] for q in queries)]) for i, kind in enumerate((np.int64, float)))
        column = self.column[term]
        rare, often = np.flatnonzero(column < 0), np.flatnonzero(column >= 0)
        sizes = self.post_first[term[rare] + 1] - self.post_first[term[rare]]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - self.post_first[term[rare]], sizes)
        sums = np.bincount(np.repeat(doc[rare] * width, sizes) + self.post_entry[at], np.repeat(weight[rare], sizes) * self.post_weight[at], m * width)
        sums = sums.reshape(m, self.blocks, size)
        dense = np.zeros((m, self.table.shape[1]))
        dense[doc[often], column[often]] = weight[often]
        bound = sums.max(axis=2) + dense @ self.block_most
        cosines = np.full((m, self.blocks, size), -1.0)

        def work_out(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                own = np.flatnonzero(wanted[:, block])
                cosines[own, block] = np.round(sums[own, block] + dense[own] @ self.table[block], 12)

        first = min(self.blocks, -(-2 * k // size))
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        wanted = np.zeros((m, self.blocks), bool)
        wanted[np.arange(m)[:, None], best] = True
        work_out(wanted)
        least = np.partition(cosines.reshape(m, -1), -min(k, width), axis=1)[:, -min(k, width)]
        work_out(~wanted & (bound > np.maximum(least, 0.0)[:, None] - 1e-9))
        cosines = cosines.reshape(m, -1)
        least = np.partition(cosines, -min(k, width), axis=1)[:, -min(k, width)]
        out = []
        for own, low in zip(cosines, least):
            near = np.flatnonzero((own >= low) & (own > 0))
            near = near[np.lexsort((near, -own[near]))[:k]]
            out.append(list(zip(own[near].tolist(), near.tolist())))
        return out

    def vote(self, near: list[tuple[float, int]], own: tuple[int, int] | None = None) -> float | None:
        """Share of toxic examples among the near ones, weighted by distance; own: an entry and the label of one of its
        examples, which is left out."""
        toxic = total = 0.0
        for cosine, e in near:
            weight = 1 / (self.s.softening + 1 - min(1.0, cosine))
            n, m = self.votes[e][:2]
            if own and own[0] == e:
                n, m = n - own[1], m - 1
            toxic += weight * n
            total += weight * m
        return toxic / total if total else None

    def own_votes(self, entries: list[int]) -> list[tuple[float, int, float]]:
        """(vote, label, weight) of the examples of these entries, each left out of its own vote."""
        spans = [slice(self.first[e], self.first[e + 1]) for e in entries]
        out = []
        for e, near in zip(entries, self.nearest_of([(self.term[x], self.weight[x]) for x in spans], self.s.near + 1)):
            toxic, every = self.votes[e][:2]
            others = near[: self.s.near] if every > 1 else [x for x in near if x[1] != e][: self.s.near]
            for label, count in ((1, toxic), (0, every - toxic)):
                if count and (v := self.vote(others, (e, label))) is not None:
                    out.append((v, label, count * (1.0 if label else self.clean_weight)))
        return out

    def calibrate(self, points: list[tuple[float, int, float]]) -> None:
        """Isotonic fit of labels on votes (pool adjacent violators), linear between the pools' mean votes."""
        pools: list[list[float]] = []
        for v, label, count in sorted(points):
            pools.append([v * count, label * count, count])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                pools[-2:] = [[a + b for a, b in zip(*pools[-2:])]]
        self.knots = ([v / n for v, _, n in pools], [(toxic + 0.5) / (n + 1) for _, toxic, n in pools])

    def scores(self, bags: list[dict[int, int]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """(probability, nearest (cosine, example id)); texts without an indexed word get the rate of such examples."""
        vectors = [self._weighted(np.fromiter(b.keys(), np.int64), np.fromiter(b.values(), np.int64)) for b in bags]
        out = []
        for near in self.nearest_of(vectors, self.s.near):
            raw = self.vote(near)
            if raw is None or not self.knots[0]:
                out.append(((self.empty[0] + self.rate) / (self.empty[1] + 1), []))
            else:
                out.append((float(np.interp(raw, *self.knots)), [(c, self.votes[e][2]) for c, e in near]))
        return out


def _examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, s: Settings) -> tuple[DataFrame, float]:
    """(id, y, text) of the bounded sample, and the weight of its clean examples.

    Ids are taken by a hash; as rows may share an id, the sample is bounded once more by rows.
    """
    usable = labels.where(quoted(doc_id).isNotNull() & quoted(label).isNotNull())
    usable = usable.groupBy(quoted(doc_id).alias("id")).agg((F.max(quoted(label).cast("int")) > 0).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    most = {0: s.clean_examples, 1: s.toxic_examples}
    share = {y: min(1.0, most[y] / max(1, n.get(y, 0))) for y in (0, 1)}
    within = F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    picked = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < within)
    own = docs.select(quoted(doc_id).alias("doc"), quoted(text).alias("text")).where("text is not null")
    found = own.join(F.broadcast(picked), F.col("doc") == F.col("id")).select("id", "y", "text")
    found = found.orderBy(F.xxhash64("id", "text"), "id").limit(2 * (s.clean_examples + s.toxic_examples))
    return found, share[1] / share[0]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Index:
    """Learn from the labelled rows given. Rows with a null id, text or label teach nothing; of several labels the largest counts."""
    s, spark = settings, docs.sparkSession
    sampled, clean_weight = _examples(docs, labels, doc_id, text, label, s)
    table = sampled.toArrow()
    terms: dict[str, int] = {}
    for t in table["text"]:
        for w in set(WORD.findall(t.as_py().lower())):
            terms.setdefault(w, len(terms))
    labels_of = table["y"].to_pylist()
    held = np.zeros((2, len(terms)), np.int64)
    for y, t in zip(labels_of, table["text"]):
        held[y, list(bag(t.as_py(), terms))] += 1
    toxic = sum(labels_of)
    known = spark.sparkContext.broadcast(terms)

    def frequencies(batches):
        df = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            df[-1] += len(texts)
            found = [known.value.get(w, -1) for t in texts for w in set(WORD.findall(t.lower()))]
            df[:-1] += np.bincount(np.array([k for k in found if k >= 0], np.int64), minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    own = docs.select(quoted(text).alias("text")).where("text is not null")
    df = own.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    seen, counted = np.zeros(len(terms) + 1), df.toArrow()  # the words of the sample
    seen[counted["term"].to_numpy()] = counted["n"].to_numpy()
    known.destroy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    weights = idf * toxic_factors(held[1], held[0], toxic, len(labels_of) - toxic, s)
    examples = ((i, y, bag(t.as_py(), terms)) for i, y, t in zip(table["id"].to_pylist(), labels_of, table["text"]))
    index = Index(terms, weights, examples, s, clean_weight)

    voting = spark.sparkContext.broadcast(index)

    def votes(batches):
        for batch in batches:
            every = batch.column(0).to_pylist()
            points = [p for at in range(0, len(every), BATCH) for p in voting.value.own_votes(every[at : at + BATCH])]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in points], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.float64()))], names=["vote", "label", "weight"])

    points = spark.range(len(index.votes)).mapInArrow(votes, "vote double, label int, weight double").collect()
    voting.destroy()
    index.calibrate([tuple(p) for p in points])
    return index


def score(docs: DataFrame, index: Index, text: str = "text", evidence: int = 3) -> DataFrame:
    """Adds toxicity (0 to 1) and the nearest examples (id, cosine) to all columns.

    Null texts are empty ones. Texts that share no word with an example have no examples, and the rate of such examples.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        own, scores, near = held.value, [], []
        for value, found in own.scores([bag(t, own.terms) for t in columns[0].to_pylist()]):
            scores.append(value)
            near.append([{"doc_id": i, "cosine": c} for c, i in found[:evidence]])
        return [pa.array(scores, pa.float64()), pa.array(near, kind)]

    return with_arrow_columns(docs, [text], {"toxicity": "double", "examples": "array<struct<doc_id:bigint,cosine:double>>"}, run, rows=BATCH)
