"""Document scores by prediction by partial matching over a byte trie learned from the corpus.

A text is its words, joined by one space, and an end. Every byte is predicted from the five before it: from the longest
context that the training texts hold, or, at the cost of an escape, from the next shorter one, in which the symbols of the
longer are excluded; below the empty context all symbols are equally likely. A context gives half a count of each of its
symbols to the escape (method D).

The trie is never gathered. It is the table of all (five bytes, next byte) counts, dealt to shards by the last three bytes
of the context, so that a shard holds whole subtrees; the contexts of up to two bytes, at most 2**16 with 256 symbols, are
known to all shards. A block of documents asks for its distinct byte runs and gets their log-probabilities. The unigram
baseline asks for word counts in the same way.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.llm import common as c
from colweave.llm.common import U64

ORDER = 5
END = 10  # a line feed: never part of a word, ends every text and stands before it
RUN_BYTES = ORDER + 1
_CHUNK = 1 << 17


def stream(found: list[bytes]) -> bytes:
    """The bytes of a text between its contexts: start padding, words, end."""
    return b"\n" * ORDER + b" ".join(found) + b"\n"


def runs(parts: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Every predicted byte with its context, as 48 bits, and the text's 16-bit mark below.

    From the top: the byte before, the one before that, ..., the predicted byte. Sorted runs thus group by context suffix.
    """
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(lengths) - lengths
    out = np.empty(len(buffer) - ORDER * len(parts), U64)
    at = 0
    mark = np.repeat(marks.astype(U64), lengths - ORDER)
    keep = np.ones(len(buffer), bool)
    keep[(first[:, None] + np.arange(ORDER)).ravel()] = False
    for low in range(ORDER, len(buffer), _CHUNK):
        high = min(len(buffer), low + _CHUNK)
        key = np.zeros(high - low, U64)
        for back in range(1, ORDER + 1):
            key = (key << U64(8)) | buffer[low - back : high - back]
        key = ((key << U64(8)) | buffer[low:high])[keep[low:high]]
        out[at : at + len(key)] = key << U64(16)
        at += len(key)
    return out[:at] | mark


def short_runs(parts: list[bytes]) -> np.ndarray:
    """Every predicted byte with the two before it, as 24 bits laid out like the longer runs."""
    buffer = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    lengths = np.array([len(p) for p in parts], np.int64)
    keep = np.ones(len(buffer), bool)
    keep[((np.cumsum(lengths) - lengths)[:, None] + np.arange(ORDER)).ravel()] = False
    return ((buffer[1:-1] << np.uint32(16)) | (buffer[:-2] << np.uint32(8)) | buffer[2:])[keep[2:]]


class Numbers(dict):
    """Word -> its number in a block, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))

    def ordered(self, shards: int) -> tuple[list[bytes], np.ndarray, list[tuple[int, int, int]]]:
        """The words by hash, their numbers, and the (shard, from, to) that own them; the same for any order of rows."""
        words = list(self)
        hashes = c.WordHashes().of(words)
        order = np.argsort(hashes)
        if len(order) and (hashes[order][1:] == hashes[order][:-1]).any():
            order = np.array(sorted(range(len(words)), key=lambda i: (int(hashes[i]), words[i])))
        return [words[i] for i in order.tolist()], order, c.by_shard(hashes[order], shards)


def groups_of(docs: list, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Consecutive texts of at most `limit` bytes together (or one longer text), and few enough for 16-bit marks."""
    out, start, size = [], 0, 0
    for i, d in enumerate(docs):
        if i > start and (size + len(d) > limit or i - start >= 60_000):
            out.append((start, i))
            start, size = i, 0
        size += len(d)
    return [*out, (start, len(docs))] if docs else out


class Trie:
    """Contexts of three to five bytes of one shard above shared contexts of up to two."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        self.tables = {}
        for order in range(ORDER, 2, -1):
            self.tables[order] = _summed(_shorter(keys, ORDER, order), counts)
        self.tables[2] = low_keys, low_counts
        for order in (1, 0):
            self.tables[order] = _summed(_shorter(low_keys, 2, order), low_counts)
        self.nodes = {}
        for order, (table, n) in self.tables.items():
            context = table >> U64(8)
            begins = c.starts_of(context)
            total = np.add.reduceat(n, begins) if len(begins) else np.zeros(0, np.int64)
            self.nodes[order] = context[begins], total, np.diff(np.append(begins, len(table)))
        self.left = {}
        for order in range(1, ORDER + 1):
            # What a context leaves in the next shorter one, when its own symbols are excluded there.
            table, _ = self.tables[order]
            context, _, kinds = self.nodes[order]
            shorter, n = self.tables[order - 1]
            found = n[np.searchsorted(shorter, _shorter(table, order, order - 1))] if len(table) else n[:0]
            begins = c.starts_of(table >> U64(8))
            inside = np.add.reduceat(found, begins) if len(begins) else np.zeros(0, np.int64)
            above, total, total_kinds = self.nodes[order - 1]
            at = np.searchsorted(above, context >> U64(8)) if order == 1 else np.searchsorted(above, _parent(context, order))
            self.left[order] = total[at] - inside, total_kinds[at] - kinds

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) for 48-bit runs."""
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        above_at = np.zeros(len(keys), np.int64)
        above_seen = np.zeros(len(keys), bool)
        for order in range(ORDER, -1, -1):
            own = _shorter(keys, ORDER, order)
            context, total, kinds = self.nodes[order]
            at, seen = _lookup(context, own >> U64(8))
            n, d = total[at] if len(total) else np.zeros(len(keys)), kinds[at] if len(kinds) else np.zeros(len(keys))
            if order < ORDER and len(self.left[order + 1][0]):
                n = np.where(above_seen, self.left[order + 1][0][above_at], n)
                d = np.where(above_seen, self.left[order + 1][1][above_at], d)
            table, counts = self.tables[order]
            k, known = _lookup(table, own)
            use = open_ & seen & (d > 0)
            hit = use & known
            miss = use & ~known
            out[hit] += np.log10(2 * counts[k[hit]] - 1) - np.log10(2 * n[hit])
            out[miss] += np.log10(d[miss]) - np.log10(2 * n[miss])
            open_ &= ~hit
            above_at, above_seen = at, seen
        out[open_] -= np.log10(256 - (int(self.nodes[0][2][0]) if len(self.nodes[0][2]) else 0))
        return out


def _shorter(keys: np.ndarray, order: int, wanted: int) -> np.ndarray:
    """The runs with only `wanted` bytes of context."""
    if order == wanted:
        return keys
    return (keys >> U64(8 * (order - wanted) + 8) << U64(8)) | (keys & U64(255))


def _parent(context: np.ndarray, order: int) -> np.ndarray:
    """Contexts of `order` bytes without their oldest one."""
    return context >> U64(8)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    begins = c.starts_of(keys)
    return keys[begins], np.add.reduceat(counts[order], begins) if len(begins) else counts[:0]


def _lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


@dataclass(frozen=True)
class Shared:
    """What is small at any size: counts of contexts of up to two bytes, training tokens, distinct training words."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    words: int


def summarize(docs: DataFrame, text: str, learned: str, shards: int) -> Shared:
    """One pass over the training texts for what every shard and document needs.

    Distinct words are counted in shards of the words' hashes; each task sends a word once.
    """

    def scan(batches):
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        known, tokens = c.WordHashes(), 0
        words: set[bytes] = set()
        for batch in batches:
            texts = [t for t, use in zip(batch.column(0), batch.column(1).to_pylist()) if use]
            for a, b in groups_of([t.as_buffer() or b"" for t in texts]):
                docs_ = [c.words(t.as_py(), lower=True) for t in texts[a:b]]
                tokens += sum(map(len, docs_)) + len(docs_)
                for found in docs_:
                    words.update(found)
                low, n = np.unique(short_runs([stream(d) for d in docs_]), return_counts=True)
                keys, counts = _summed(np.concatenate([keys, low.astype(U64)]), np.concatenate([counts, n]))
            if len(words) > 400_000:
                yield rows(words, known, keys[:0], counts[:0], 0)
                words.clear()
        yield rows(words, known, keys, counts, tokens)

    def rows(words, known, keys, counts, tokens):
        ordered = sorted(words)
        owner = (known.of(ordered) % U64(shards)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        split = np.split(order, c.starts_of(owner[order])[1:]) if ordered else []
        kind = [0] * len(keys) + [1] + [2] * len(split)
        key = [*keys.tolist(), 0, *(int(owner[s[0]]) for s in split)]
        n = [*counts.tolist(), tokens, *(0 for _ in split)]
        data = [None] * (len(keys) + 1) + [b" ".join(ordered[i] for i in s) for s in split]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "n", "data"])

    def distinct(table: pa.Table) -> pa.Table:
        every: set[bytes] = set()
        for x in table["data"]:
            every.update(x.as_py().split(b" "))
        return pa.table({"n": pa.array([len(every)], pa.int64())})

    found = c.stored(docs.select(c.quoted(text).alias("text"), c.quoted(learned).alias("learned")).where("learned").mapInArrow(scan, "kind int, key bigint, n bigint, data binary"), "summary")
    low = found.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    tokens = found.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    words = found.where("kind = 2").select("key", "data").groupBy("key").applyInArrow(distinct, "n bigint").agg(F.sum("n")).first()[0] or 0
    ends = 1 if tokens else 0
    return Shared(np.array([r["key"] for r in low], U64), np.array([r["n"] for r in low], np.int64), tokens, words + ends)


ASKED = "block int, shard int, keys binary, words binary, counts binary"


def score(docs: DataFrame, learned: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = c.BLOCK_BYTES) -> DataFrame:
    """All columns, then n_tokens, n_known, train_tokens, base_score and score.

    `learned` names a boolean column that marks the training rows. Null and empty texts have one token, their end. Without
    training rows the baseline has one unknown token and every byte is equally likely.
    """
    outputs = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    names = [n for n in docs.columns if n.lower() not in outputs]
    blocks = c.block_count(docs, text, block_bytes)
    shared = summarize(docs, text, learned, blocks)
    held = docs.sparkSession.sparkContext.broadcast(shared)
    block = c.block_of([c.quoted(doc_id), c.quoted(text)], blocks)
    base = docs.select(block, F.coalesce(c.quoted(learned), F.lit(False)).alias("learned"), *[c.quoted(n).alias(f"c{i}") for i, n in enumerate(names)])
    texts = f"c{names.index(text)}"

    def owner_of_runs(keys: np.ndarray) -> np.ndarray:
        return (c.mix(keys >> U64(24)) % U64(blocks)).astype(np.int64)

    def split(owner: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(owner, kind="stable")
        return {int(owner[part[0]]): part for part in np.split(order, c.starts_of(owner[order])[1:])} if len(owner) else {}

    def chunks(table: pa.Table):
        """(from, word lists) of the block's texts, a bounded share of them at a time."""
        column = table[texts].combine_chunks()
        for a, b in groups_of([t.as_buffer() or b"" for t in column]):
            yield a, [c.words(t.as_py(), lower=True) for t in column.slice(a, b - a)]

    def ask(table: pa.Table) -> pa.Table:
        use = table["learned"].to_numpy().astype(np.int64)
        numbers, tally, made = Numbers(), np.zeros(0, np.int64), []
        for at, docs_ in chunks(table):
            own = use[at : at + len(docs_)]
            ids = [numbers.of(found) for found in docs_]
            grown = np.zeros(len(numbers), np.int64)
            grown[: len(tally)] = tally
            tally = grown + np.bincount(np.concatenate([np.zeros(0, np.int32), *(i for i, u in zip(ids, own.tolist()) if u)]), minlength=len(numbers))
            packed = np.sort(runs([stream(d) for d in docs_], own))
            keys = packed >> U64(16)
            begins = c.starts_of(keys)
            made.append((keys[begins], np.add.reduceat((packed & U64(1)).astype(np.int64), begins)))
        keys, counts = _summed(np.concatenate([k for k, _ in made]), np.concatenate([n for _, n in made]))
        words, order, word_parts = numbers.ordered(blocks)
        times, of_words = tally[order], {shard: (a, b) for shard, a, b in word_parts}
        of_runs = split(owner_of_runs(keys))
        rows = []
        for shard in sorted(of_words.keys() | of_runs.keys()):
            (a, b), r = of_words.get(shard, (0, 0)), of_runs.get(shard, np.zeros(0, np.int64))
            own = np.concatenate([counts[r], times[a:b]]).astype(np.uint32)
            rows.append((shard, keys[r].tobytes(), b" ".join(words[a:b]), own.tobytes()))
        block = table["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int32()),
                "shard": pa.array([r[0] for r in rows], pa.int32()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "words": pa.array([r[2] for r in rows], pa.binary()),
                "counts": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), U64) for x in table["keys"]]
        words = [x.as_py().split() for x in table["words"]]
        counts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table["counts"]]
        every, total = _summed(np.concatenate(parts), np.concatenate([n[: len(p)] for n, p in zip(counts, parts)]))
        trie = Trie(every[total > 0], total[total > 0], held.value.keys, held.value.counts)
        bits = trie.log10(every).astype(np.float32)
        tally: Counter = Counter()
        for found, n, p in zip(words, counts, parts):
            for w, k in zip(found, n[len(p) :].tolist()):
                tally[w] += k
        return pa.table(
            {
                "block": table["block"],
                "shard": table["shard"],
                "logs": pa.array([bits[np.searchsorted(every, p)].tobytes() for p in parts], pa.binary()),
                "totals": pa.array([np.array([tally[w] for w in found], np.int64).tobytes() for found in words], pa.binary()),
            }
        )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        logs = {s: np.frombuffer(x.as_buffer(), np.float32) for s, x in zip(answers["shard"].to_pylist(), answers["logs"])}
        totals = {s: np.frombuffer(x.as_buffer(), np.int64) for s, x in zip(answers["shard"].to_pylist(), answers["totals"])}
        numbers, kept = Numbers(), []
        for _, docs_ in chunks(table):
            packed = np.sort(runs([stream(d) for d in docs_], np.arange(len(docs_))))
            keys = packed >> U64(16)
            begins = c.starts_of(keys)
            ids = [numbers.of(found) for found in docs_]
            kept.append((keys[begins], np.diff(np.append(begins, len(keys))), (packed & U64(0xFFFF)).astype(np.uint16), np.concatenate(ids), np.array([len(i) for i in ids])))
        keys = np.sort(np.concatenate([k[0] for k in kept]))
        keys = keys[c.starts_of(keys)]
        value = np.zeros(len(keys))
        for shard, at in split(owner_of_runs(keys)).items():
            value[at] = logs[shard]
        _, order, word_parts = numbers.ordered(blocks)
        count = np.zeros(len(numbers), np.int64)
        for shard, a, b in word_parts:
            count[order[a:b]] = totals[shard]
        ends = _ends(held.value)
        word_log, end_log = np.log10(count + 1), np.log10(ends + 1)
        divisor = np.log10(held.value.tokens + held.value.words + 1)
        n_tokens, n_known, base_scores, scores = [], [], [], []
        for own, times, mark, ids, sizes in kept:
            each = np.repeat(value[np.searchsorted(keys, own)], times)
            scores += np.bincount(mark, each, len(sizes)).tolist()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            n_tokens += (sizes + 1).tolist()
            n_known += (np.bincount(doc, count[ids] > 0, len(sizes)).astype(np.int64) + (ends > 0)).tolist()
            base_scores += (np.bincount(doc, word_log[ids], len(sizes)) + end_log - (sizes + 1) * divisor).tolist()
        made = {f.name: table[f.name] for f in fields[: len(names)]}
        made |= {"n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64())}
        made |= {"train_tokens": pa.array([held.value.tokens] * len(scores), pa.int64()), "base_score": pa.array(base_scores, pa.float64()), "score": pa.array(scores, pa.float64())}
        return pa.table(made)

    fields = [T.StructField(f"c{i}", docs.schema[n].dataType) for i, n in enumerate(names)]
    fields += [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]
    by_block = base.groupBy("block")
    answers = by_block.applyInArrow(ask, ASKED).groupBy("shard").applyInArrow(answer, "block int, shard int, logs binary, totals binary")
    result = by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, T.StructType(fields))
    return result.toDF(*names, *outputs)


def _ends(shared: Shared) -> int:
    """Training texts: each ends once, and an end is the only run that predicts a line feed."""
    return int(shared.counts[(shared.keys & U64(255)) == END].sum())
