"""Benchmark decontamination: BM25 with block-max WAND over test items, queried by every document and passage.

An item counts as leaked if its question and its answer overlap with the document in runs of five words. Items are the
entries of a BM25 index whose weights are divided by the least weight that an accepted overlap with the item can hold,
worked out over the lightest runs of question, answer and whole. An accepted overlap then weighs at least 1, so the
threshold 1 over a document's distinct words excludes nothing that verification accepts. Every document is a query; block
maxima skip the entries out of reach, and the overlap of question and answer is verified for what is retrieved.

Leaks are then placed in passages, which are the queries of a second index. A posting there holds the BM25 weight of a term
in an item divided by the item's own total, so a passage that holds all words of an item scores 1 and one threshold serves
all items. A leak that no passage holds to the threshold, as it is partial or spread over the document, is scored in every
passage. Long items are split into texts of at most `entry_words` words, and passages overlap by at least as much, so each
that a document holds lies whole in one passage.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import mix, quoted, rolling, starts_of, stored, union_all, with_arrow_columns

WORD = re.compile(r"\w+")
BATCH = 512
LEAKS = "array<struct<item_id:bigint,passage:int,score:double,question_overlap:double,answer_overlap:double>>"


@dataclass(frozen=True)
class Settings:
    """index_bytes bounds the item text of one broadcast index; a larger benchmark is searched slice by slice."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.7
    frequent_share: float = 0.5
    part_overlap: float = 0.5
    whole_overlap: float = 0.8
    shingle: int = 5
    entry_words: int = 256
    least_stride: int = 64
    postings_block: int = 32
    index_bytes: int = 32 << 20


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line, or the last sentence of a text of one line; a single sentence is all question."""
    lines = [x for x in text.splitlines() if WORD.search(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", text) if WORD.search(x)]
    if len(lines) < 2:
        return split_words(text), []
    return split_words("\n".join(lines[:-1])), split_words(lines[-1])


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def run_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` neighbouring term numbers."""
    return rolling(mix((ids + 2).astype(np.uint64)), width)


class Statistics:
    """BM25 weights of a text's distinct terms, from the document frequencies of all items."""

    def __init__(self, df: dict[str, int], texts: int, mean_words: float, s: Settings):
        self.df, self.texts, self.mean_words, self.s = df, texts, mean_words, s

    def weights(self, words: list[str]) -> dict[str, float]:
        s, tf = self.s, Counter(words)
        norm = s.k1 * (1 - s.b + s.b * len(words) / self.mean_words)
        return {t: math.log(1 + (self.texts - self.df[t] + 0.5) / (self.df[t] + 0.5)) * n * (s.k1 + 1) / (n + norm) for t, n in tf.items()}


def lightest_runs(weights: np.ndarray, width: int, need: int) -> float:
    """The least weight that any `need` runs of `width` neighbouring positions cover, each position counted once."""
    if not need:
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    far = width + 1
    # best[j][n]: n runs chosen, the last of them j positions back (width: no overlap any more).
    best = np.full((far, need + 1), np.inf)
    best[width, 0] = 0.0
    for i in range(len(weights) - width + 1):
        chosen = np.full(need + 1, np.inf)
        for j in range(1, far):
            chosen[1:] = np.minimum(chosen[1:], best[j, :-1] + sums[i + width] - sums[i + width - j])
        best[width] = np.minimum(best[width], best[width - 1])
        best[2:width] = best[1 : width - 1].copy()
        if width > 1:
            best[1] = chosen
        else:
            best[width] = np.minimum(best[width], chosen)
    return float(best[:, need].min())


def least_accepted(question: list[str], answer: list[str], whole: list[str], weight: dict[str, float], s: Settings) -> float:
    """No more than the weight of the distinct words that an accepted overlap with the item holds.

    Every occurrence of a word has an equal part of its weight, so distinct words weigh at least as much as any of their
    occurrences together.
    """
    often = Counter(whole)

    def least(words: list[str], overlap: float) -> float:
        width = min(s.shingle, len(words))
        need = math.ceil(overlap * len(shingles(words, s.shingle)) - 1e-9)
        return lightest_runs(np.array([weight[w] / often[w] for w in words]), width, need) if words else 0.0

    return min(least(question, s.part_overlap) + least(answer, s.part_overlap), least(whole, s.whole_overlap))


class Postings:
    """Postings of terms over entries, ordered by entry, with the largest weight of every block of postings."""

    def __init__(self, entries: list[dict[int, float]], terms: int, threshold: float, s: Settings):
        self.size, self.terms, self.threshold = len(entries), terms, threshold
        self.at: list[list[int]] = [[] for _ in range(terms)]
        self.weight: list[list[float]] = [[] for _ in range(terms)]
        for e, weights in enumerate(entries):
            for t, w in weights.items():
                self.at[t].append(e)
                self.weight[t].append(w)
        size = s.postings_block
        self.block_last = [[a[min(i + size, len(a)) - 1] for i in range(0, len(a), size)] for a in self.at]
        self.block_max = [[max(w[i : i + size]) for i in range(0, len(w), size)] for w in self.weight]
        self.most = [max(w, default=0.0) for w in self.weight]
        self._split_terms(s.frequent_share * threshold)

    def _split_terms(self, limit: float) -> None:
        """Leave to WAND's last step the frequent terms, which hold at most a share of the threshold in any entry.

        No entry reaches the threshold without the other, essential terms, so only their postings pick the queries.
        """
        self.frequent = np.zeros(self.size)
        essential = np.ones(self.terms, bool)
        for t in sorted(range(self.terms), key=lambda t: -len(self.at[t])):
            after = self.frequent[self.at[t]] + self.weight[t]
            if (after <= limit).all():
                self.frequent[self.at[t]] = after
                essential[t] = False
        sizes = np.array([len(a) if e else 0 for a, e in zip(self.at, essential)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.flat_at = np.array([x for a, e in zip(self.at, essential) if e for x in a], np.int64)
        self.flat_weight = np.array([x for w, e in zip(self.weight, essential) if e for x in w])

    def within_reach(self, query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs whose essential terms leave the threshold within reach; (query, term) pairs are distinct."""
        sizes = self.first[term + 1] - self.first[term]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[term], sizes)
        pair = np.repeat(query, sizes) * self.size + self.flat_at[inside]
        order = np.argsort(pair)
        pair = pair[order]
        begins = starts_of(pair)
        reached = np.add.reduceat(self.flat_weight[inside][order], begins) if len(begins) else np.zeros(0)
        pair = pair[begins]
        reached += self.frequent[pair % max(1, self.size)]
        pair = pair[reached >= self.threshold - 1e-9]
        return pair // max(1, self.size), pair % max(1, self.size)

    def search(self, terms: list[int]) -> dict[int, float]:
        """Every entry whose weights over the distinct terms reach the threshold, with its score."""
        least = self.threshold - 1e-9
        cursors = [[self.at[t][0], 0, t] for t in terms if self.at[t]]
        found = {}
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            inside, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else self.size
            for _, _, t in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[t], entry)
                if block < len(self.block_last[t]):
                    inside += self.block_max[t][block]
                    until = min(until, self.block_last[t][block] + 1)
            if inside >= least:
                score = sum(self.weight[t][p] for e, p, t in cursors[: pivot + 1] if e == entry) if cursors[0][0] == entry else None
                if score is None:
                    until = entry
                else:
                    until = entry + 1
                    if score >= least:
                        found[entry] = score
            until = max(until, entry) if inside >= least else max(until, entry + 1)
            moved = []
            for e, p, t in cursors[: pivot + 1]:
                if e < until:
                    p = bisect_left(self.at[t], until, p)
                    if p == len(self.at[t]):
                        continue
                    e = self.at[t][p]
                moved.append([e, p, t])
            cursors = moved + cursors[pivot + 1 :]


class Index:
    """Two indexes over the same terms: whole items for retrieval, their texts for placing leaks in passages."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], texts: int, mean_words: float, s: Settings):
        self.s, self.items = s, items
        statistics = Statistics(df, texts, mean_words, s)
        self.terms: dict[str, int] = {}
        self.entry_item: list[int] = []
        self.item_entry = [0]
        self.longest = 1
        self.item_terms: list[set[int]] = []
        self.parts: list[list[tuple[int, frozenset, np.ndarray]]] = []  # question, answer, whole: width, runs, their hashes
        retrieval, placing = [], []
        for i, (_, text) in enumerate(items):
            parts = (*question_and_answer(text), split_words(text))
            self.item_terms.append({self._number(t) for t in parts[-1]})
            weight = statistics.weights(parts[-1])
            least = least_accepted(*parts, weight, s)
            retrieval.append({self._number(t): w / least for t, w in weight.items()})
            self.parts.append([(width := min(s.shingle, len(words)), frozenset(shingles(words, s.shingle)), self._hashes(words, width)) for words in parts])
            for words in entries_of(text, s.entry_words):
                self.longest = max(self.longest, len(words))
                weight = statistics.weights(words)
                total = sum(weight.values())
                placing.append({self._number(t): w / total for t, w in weight.items()})
                self.entry_item.append(i)
            self.item_entry.append(len(self.entry_item))
        self.retrieval = Postings(retrieval, len(self.terms), 1.0, s)
        self.placing = Postings(placing, len(self.terms), s.threshold, s)
        self.at, self.weight, self.search = self.placing.at, self.placing.weight, self.placing.search

    def _number(self, term: str) -> int:
        return self.terms.setdefault(term, len(self.terms))

    def _hashes(self, words: list[str], width: int) -> np.ndarray:
        return np.unique(run_hashes(np.array([self._number(t) for t in words], np.int64), width))

    def retrieved(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(document, items) for the documents of a batch that retrieve any; ids: term numbers (-1: no item's) of all."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        of = np.searchsorted(begins, at, side="right") - 1
        held = np.unique(of * len(self.terms) + ids[at])
        of, term = held // len(self.terms), held % len(self.terms)
        reached: dict[int, set[int]] = defaultdict(set)
        for d, i in zip(*(x.tolist() for x in self.retrieval.within_reach(of, term))):
            reached[d] |= self.item_terms[i]
        for d, terms in reached.items():
            low, high = np.searchsorted(of, (d, d + 1))
            if items := sorted(self.retrieval.search([t for t in term[low:high].tolist() if t in terms])):
                yield d, items

    def passages(self, ids: np.ndarray, stride: int) -> np.ndarray:
        """Passages that leave some text within reach of the threshold; passage k starts at k * stride."""
        last = max(1, -(-len(ids) // stride) - 1) - 1
        at = np.flatnonzero(ids >= 0)
        half, term = at // stride, ids[at].astype(np.int64)
        held = np.concatenate([np.minimum(half, last) * len(self.terms) + term, np.clip(half - 1, 0, last) * len(self.terms) + term])
        held = np.unique(held)
        return np.unique(self.placing.within_reach(held // len(self.terms), held % len(self.terms))[0])

    def best_passages(self, ids: np.ndarray, stride: int, items: list[int]) -> dict[int, tuple[float, int]]:
        """Item -> (score, start) of its best passage, for those of the items that some passage holds to the threshold."""
        best: dict[int, tuple[float, int]] = {}
        wanted = set().union(*(self.item_terms[i] for i in items))
        ids = np.where(np.isin(ids, list(wanted)), ids, -1)
        for k in self.passages(ids, stride).tolist():
            a = k * stride
            for entry, score in self.search(sorted(wanted.intersection(ids[a : a + 2 * stride].tolist()))).items():
                i = self.entry_item[entry]
                if i not in best or score > best[i][0] + 1e-12:
                    best[i] = (score, a)
        return best

    def best_passage(self, i: int, ids: np.ndarray, stride: int) -> tuple[float, int]:
        """(score, start) of the passage that holds most of one of the item's entries, also below the threshold."""
        best = (-1.0, 0)
        terms = sorted({self.terms[w] for w in split_words(self.items[i][1])})
        weights: dict[int, dict[int, float]] = defaultdict(dict)
        for t in terms:
            for p in range(bisect_left(self.at[t], self.item_entry[i]), bisect_left(self.at[t], self.item_entry[i + 1])):
                weights[self.at[t][p]][t] = self.weight[t][p]
        at = np.flatnonzero(np.isin(ids, terms))
        last = max(1, -(-len(ids) // stride) - 1) - 1
        for k in np.unique(np.clip(np.concatenate([at // stride, at // stride - 1]), 0, last)).tolist():
            a = k * stride
            inside = set(ids[at[np.searchsorted(at, a) : np.searchsorted(at, a + 2 * stride)]].tolist())
            for own in weights.values():
                score = sum(w for t, w in own.items() if t in inside)
                if score > best[0] + 1e-12:
                    best = (score, a)
        return best

    def leaks(self, words: list[str], ids: np.ndarray, retrieved: list[int]) -> list[dict]:
        """Those of the retrieved items that a document of these words leaks, each with its best passage, by item order."""
        accepted = []
        inside: dict[int, np.ndarray] = {}
        for i in retrieved:
            shares = []
            for width, own, hashes in self.parts[i]:
                if not own:
                    shares.append(None)
                    continue
                if width not in inside:
                    inside[width] = run_hashes(ids, width)
                at = np.flatnonzero(np.isin(inside[width], hashes)).tolist()
                shares.append(len(own & {tuple(words[p : p + width]) for p in at}) / len(own))
            asked, answered, whole = shares
            if whole >= self.s.whole_overlap or (asked >= self.s.part_overlap and (answered is None or answered >= self.s.part_overlap)):
                accepted.append((i, asked, answered))
        stride = max(self.s.least_stride, self.longest)
        best = self.best_passages(ids, stride, [i for i, _, _ in accepted]) if accepted else {}
        out = []
        for i, asked, answered in accepted:
            score, a = best[i] if i in best else self.best_passage(i, ids, stride)
            out.append({"item_id": self.items[i][0], "passage": a, "score": score, "question_overlap": asked, "answer_overlap": answered})
        return out

    def leaks_of(self, texts: list[str | None]) -> list[list[dict]]:
        """Leaks of every text of a batch, whose words are numbered together."""
        out: list[list[dict]] = [[] for _ in texts]
        words = [split_words(t) for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        numbers = map(self.terms.get, itertools.chain.from_iterable(words), itertools.repeat(-1))
        ids = np.fromiter(numbers, np.int64, int(begins[-1]))
        for d, items in self.retrieved(ids, begins):
            out[d] = self.leaks(words[d], ids[begins[d] : begins[d + 1]], items)
        return out


def entries_of(text: str | None, size: int) -> list[list[str]]:
    found = split_words(text)
    return [found[i : i + size] for i in range(0, len(found), size)]


class Indexes:
    """The slices of a benchmark, of at most `index_bytes` of item text each; each is built when its turn comes."""

    def __init__(self, items: DataFrame, statistics: DataFrame, slices: int, texts: int, mean_words: float, s: Settings):
        self.items, self.statistics, self.slices, self.texts, self.mean_words, self.s = items, statistics, slices, texts, mean_words, s

    def __iter__(self) -> Iterator[Index]:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.slices))
        for k in range(self.slices):
            own = self.items.where(part == k)
            rows = [(r["item_id"], r["text"]) for r in own.collect()]
            if not rows:
                continue
            words = own.select("text").mapInArrow(_distinct_words, "term string").distinct()
            df = {r["term"]: r["n"] for r in self.statistics.join(words, "term").collect()}
            yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), df, self.texts, self.mean_words, self.s)


def _distinct_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array({w for t in batch.column(0).to_pylist() for w in split_words(t)}, pa.string())], names=["term"])


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", settings: Settings = Settings()) -> Indexes:
    """The benchmark in slices; term statistics come from all items and are read slice by slice.

    Items whose text is null or without a word cannot leak and are left out. An item without an id keeps its null.
    """
    usable = items.where(F.col(text).rlike(r"(?U)\w")).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    size = usable.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    slices = max(1, -(-size // settings.index_bytes))

    def counts(batches):
        df, texts, total = Counter(), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in entries_of(t, settings.entry_words):
                    df.update(set(part))
                    texts, total = texts + 1, total + len(part)
        df[""] = texts
        df[" "] = total
        yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], names=["term", "n"])

    terms = stored(usable.select("text").mapInArrow(counts, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    sums = {r["term"]: r["n"] for r in terms.where("term in ('', ' ')").collect()}
    texts = sums.get("", 0)
    return Indexes(usable, terms, slices if texts else 0, texts, sums.get(" ", 0) / max(1, texts), settings)


def _with_leaks(docs: DataFrame, index: Index, text: str) -> tuple[DataFrame, Broadcast]:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def scan(columns: list[pa.Array]) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int32()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        return [pa.array(held.value.leaks_of(columns[0].to_pylist()), kind)]

    return with_arrow_columns(docs, [text], {"leaks": LEAKS}, scan, rows=BATCH), held


def find_leaks(docs: DataFrame, indexes: Indexes, text: str = "text") -> DataFrame:
    """Adds `leaks`: the items that each document's whole text leaks, empty for null, empty and clean texts.

    A benchmark of one slice is searched in one pass. With more of them, each slice is broadcast, searched and released
    before the next is built; what its texts leak is kept by the text's digest and joined at the end.
    """
    slices = iter(indexes)
    first, second = next(slices, None), next(slices, None)
    names = [c for c in docs.columns if c.lower() != "leaks"]
    if first is None:
        return docs.select(*[quoted(c) for c in names], F.array().cast(LEAKS).alias("leaks"))
    if second is None:
        return _with_leaks(docs, first, text)[0]
    texts = docs.select(quoted(text).alias("text")).where("text is not null")
    found = []
    for index in itertools.chain([first, second], slices):
        first = second = None
        leaking, held = _with_leaks(texts, index, "text")
        found.append(stored(leaking.where(F.size("leaks") > 0).select(F.md5(F.col("text").cast("binary")).alias("leak_digest"), "leaks").dropDuplicates(["leak_digest"]), "leaks"))
        held.destroy()
    sums = union_all(found).groupBy("leak_digest").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    plain = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], F.md5(quoted(text).cast("binary")).alias("leak_digest"))
    out = plain.join(sums, "leak_digest", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))
