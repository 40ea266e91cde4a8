"""Language identification by cross-parsing.

A suffix automaton of labelled text is built for each language. A document is parsed against every automaton: each phrase
is the longest run of letters, from where the last phrase ended, that occurs in the language's text. The fewer phrases, the
closer the language; a phrase costs the logarithm of the automaton's text length, divided by the document's length.

The automata are walked by many pieces of text at once, one letter a step, so that a step is a few array operations.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.llm.common import starts_of, with_arrow_columns

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample: the automata are broadcast, so their size must not follow the corpus.

    Every language is learned. sample_docs: labelled documents of one that are looked at, taken by a hash of the id.
    chars_total: characters of all samples together, divided over the languages; chars_per_language: of one at most.
    Documents are never cut: those that fit the budget are learned from as a whole, and if none fits, the shortest one.
    """

    sample_docs: int = 300
    chars_per_language: int = 60_000
    chars_total: int = 400_000
    letters: int = 62
    piece: int = 256


@dataclass
class Automaton:
    language: str
    columns: np.ndarray  # letter -> column of the moves; 0 for letters that its text lacks
    moves: np.ndarray  # state * width + column -> state; 0 is both the root and "no move"
    cost: float


@dataclass
class Model:
    classes: np.ndarray  # code point -> 0 for no letter, else the letter's number
    alphabet: int
    automata: list[Automaton]


def letter_classes(texts: list[str], letters: int) -> tuple[np.ndarray, int]:
    """Code points to letter numbers: lower and upper case alike, frequent letters alone, the rest by script blocks."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    own = {c: i + 1 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:letters])}
    shared = len(own) + 1
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            classes[point] = own.get(c.lower()[0], shared + (point >> 8) % 16)
    return classes, shared + 16


def codes(text: str | None, classes: np.ndarray) -> np.ndarray:
    """Letter numbers of a text; runs of other characters become one 0 between words."""
    if not text:
        return np.zeros(0, np.uint8)
    found = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = found > 0
    keep[1:] |= found[:-1] > 0
    found = found[keep]
    return found[:-1] if len(found) and not found[-1] else found


def automaton(language: str, text: np.ndarray, alphabet: int) -> Automaton:
    """The suffix automaton of a sequence of letters, with its moves in one table of the letters that occur."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    own = np.unique(text)
    columns = np.zeros(alphabet, np.uint8)
    columns[own] = np.arange(1, len(own) + 1)
    width, column = len(own) + 1, columns.tolist()
    table = np.zeros(len(moves) * width, np.int32)
    at = np.fromiter((s * width + column[c] for s, m in enumerate(moves) for c in m), np.int64)
    table[at] = np.fromiter((t for m in moves for t in m.values()), np.int32)
    return Automaton(language, columns, table, float(np.log2(max(2, len(text)))))


def fitting(sizes: list[tuple[int, int]], budget: int) -> list[int]:
    """Keys of (key, size) that fit the budget together, in order; if none fits alone, that of the smallest."""
    keys, left = [], budget
    for key, size in sizes:
        if size <= left:
            keys.append(key)
            left -= size
    return keys or [key for _, key in sorted((size, key) for key, size in sizes)[:1]]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from the rows that have text and language. The caller leaves out rows that may not be learned from."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    spark, kind = docs.sparkSession, docs.schema[lang].dataType
    # Equal texts of a language have one key, so a repeated text is learned from once.
    labelled = usable.where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("order"), F.length(text).alias("size"), F.col(text).alias("text"))
    counts = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("order").alias("least")).collect()}
    names = sorted(counts)
    if not names:
        return Model(*letter_classes([], settings.letters), [])
    # A threshold on the hash leaves a few times the sample, so that no task has to rank all rows of a language; the least
    # key stays, as copies of few texts could all miss it.
    shares = [(n, int(min(1.0, 4 * settings.sample_docs / counts[n]["n"]) * (1 << 30)), counts[n]["least"]) for n in names]
    shares = spark.createDataFrame(shares, T.StructType([T.StructField("lang", kind), T.StructField("share", T.LongType()), T.StructField("least", T.LongType())]))
    hashed = F.pmod(F.xxhash64("order", F.lit(1)), F.lit(1 << 30))
    ranked = labelled.join(shares, "lang").where((hashed < F.col("share")) | (F.col("order") == F.col("least")))
    first = Window.partitionBy("lang").orderBy("order")
    sizes = ranked.select("lang", "order", "size").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= settings.sample_docs)
    share = min(settings.chars_per_language, settings.chars_total // len(names))
    looked: dict[str, list[tuple[int, int]]] = {}
    for r in sizes.collect():
        looked.setdefault(r["lang"], []).append((r["order"], r["size"]))
    wanted = [(n, o) for n in sorted(looked) for o in fitting(sorted(looked[n]), share)]
    wanted = spark.createDataFrame(wanted, T.StructType([T.StructField("lang", kind), T.StructField("order", T.LongType())]))
    rows = labelled.join(wanted, ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {n: [] for n in names}
    for r in sorted(rows, key=lambda r: (r["order"], r["text"])):
        samples[r["lang"]].append(r["text"])
    classes, alphabet = letter_classes([t for s in samples.values() for t in s], settings.letters)
    automata = []
    for name in names:
        parts = [np.append(codes(t, classes), np.uint8(0)) for t in samples[name]]
        joined = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        if joined.any():
            automata.append(automaton(name, joined, alphabet))
    return Model(classes, alphabet, automata)


def phrase_counts(pieces: np.ndarray, lengths: np.ndarray, found: Automaton) -> np.ndarray:
    """Phrases of every piece. `pieces` holds one piece a column, longest first; `lengths` their letters."""
    moves, width = found.moves, np.int32(found.columns.max() + 1)
    root = moves[:width]
    pieces = found.columns[pieces]
    state = np.zeros(pieces.shape[1], np.int32)
    count = np.zeros(pieces.shape[1], np.int32)
    active = np.searchsorted(-lengths, -np.arange(pieces.shape[0]), side="left")
    for step, n in enumerate(active):
        if not n:
            break
        c = pieces[step, :n]
        before = state[:n]
        after = moves[before * width + c]
        stuck = after == 0
        again = root[c]
        count[:n] += (stuck & (before != 0)).view(np.int8)
        count[:n] += (stuck & (again == 0)).view(np.int8)
        state[:n] = np.where(stuck, again, after)
    return count + (state != 0)


def costs(texts: list[str | None], model: Model, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits a letter for each text and language, letters of each text)."""
    parts = [codes(t, model.classes) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    total = np.zeros((len(texts), len(model.automata)))
    row, start = [], []
    for i, p in enumerate(parts):
        row += [i] * -(-len(p) // piece)
        start += range(0, len(p), piece)
    if row and model.automata:
        row = np.array(row)
        length = np.minimum(piece, sizes[row] - np.array(start))
        order = np.argsort(-length, kind="stable")
        lanes = np.zeros((len(row), piece), np.uint8)
        for k, (i, s) in enumerate(zip(row.tolist(), start)):
            own = parts[i][s : s + piece]
            lanes[k, : len(own)] = own
        lanes = np.ascontiguousarray(lanes[order].T)
        for k, a in enumerate(model.automata):
            phrases = phrase_counts(lanes, length[order], a)
            total[:, k] = np.bincount(row[order], phrases, len(texts)) * a.cost
    return total / np.maximum(sizes, 1)[:, None], sizes


def identify(docs: DataFrame, model: Model, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Adds lang_pred and lang_score to all columns.

    Texts that are null, empty or without a letter, and all texts if nothing was learned, get `und` and score 0. Ties go
    to the first language name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [a.language for a in model.automata]

    def label(columns: list[pa.Array]) -> list[pa.Array]:
        (column,) = columns
        sizes = pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // (1 << 20)
        cuts = np.append(starts_of(group), len(group))
        pred, score = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            cost, letters = costs(column.slice(a, b - a).to_pylist(), held.value, settings.piece)
            for c, n in zip(cost, letters):
                best = int(np.argmin(c)) if n and names else -1
                pred.append(names[best] if best >= 0 else UNKNOWN)
                score.append(float(1 / np.exp2(-(c - c[best]) * min(int(n), 24)).sum()) if best >= 0 else 0.0)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return with_arrow_columns(docs, [text], {"lang_pred": "string", "lang_score": "double"}, label)
