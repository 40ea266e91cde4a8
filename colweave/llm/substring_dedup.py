"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of every `length - anchor + 1` consecutive word n-grams of `anchor` words, the one with the
smallest hash. Every passage of `length` words thus holds a seed, and equal passages hold equal seeds. Seeds that occur
once in the corpus are dropped. The others are extended both ways to all passages of `length` words around them, and an
extension is kept if it meets an equal extension anywhere; overlapping ones join into maximal repeats.

Seeds and extensions meet in shards of hashes, each block of documents asking about its own, so a passage that thousands
of documents share costs one key for each block and never a pair. Equality is that of 64-bit hashes of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.llm import common as c


BLOCK_BYTES = 8 << 20


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of every `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    if size < width:
        shift = width - size
        values = pick(values[:-shift], values[shift:])
    return values


def seeds(words: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed anchors of a document's word hashes; ties are all seeds."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = c.rolling(words, anchor)
    width = length - anchor + 1
    low = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == grams)
    return at, grams[at]


def extensions(words: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all passages of `length` words that hold a seed at one of the positions."""
    edges = np.zeros(max(0, len(words) - length + 1) + 1, np.int64)
    if len(at):
        np.add.at(edges, np.maximum(at - (length - anchor), 0), 1)
        np.add.at(edges, np.minimum(at + 1, len(edges) - 1), -1)
    starts = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    return starts, c.rolling(words, length)[starts] if len(starts) else np.zeros(0, np.uint64)


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of `size` words lie in a passage that begins at one of the starts."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 35, anchor: int = 16) -> DataFrame:
    """All columns, then n_words, n_removed, kept (the words left, joined by one space) and spans (removed word ranges).

    A null text has no words. Rows are documents, also if they share an id: their passages count as repeats. Documents
    shorter than `length` words lose nothing.
    """
    names = [n for n in docs.columns if n.lower() not in ("n_words", "n_removed", "kept", "spans")]
    blocks = c.block_count(docs, text, BLOCK_BYTES)
    block = c.block_of([c.quoted(doc_id), c.quoted(text)], blocks)
    base = docs.select(block, *[c.quoted(n).alias(f"c{i}") for i, n in enumerate(names)])
    texts = f"c{names.index(text)}"
    fields = [T.StructField(f"c{i}", docs.schema[n].dataType) for i, n in enumerate(names)]

    def hashed(table: pa.Table):
        """Word hashes of each text; the words themselves are not kept."""
        known = c.WordHashes()
        for value in table[texts]:
            yield known.of(c.words(value.as_py()))

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def ask_seeds(table: pa.Table) -> pa.Table:
        return c.pieces_of(table["block"][0].as_py(), joined([seeds(h, length, anchor)[1] for h in hashed(table)]), blocks, c.FILTER_BYTES)

    def extended(table: pa.Table, answers: pa.Table):
        """Number of words, starts and hashes of the extensions, for each document of a block."""
        docs_of = [(h, *seeds(h, length, anchor)) for h in hashed(table)]
        again = c.answered(joined([x[2] for x in docs_of]), answers, blocks)
        cuts = np.cumsum([len(x[2]) for x in docs_of])[:-1]
        for (h, at, _), keep in zip(docs_of, np.split(again, cuts)):
            yield len(h), *extensions(h, at[keep], length, anchor)

    def ask_extensions(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        return c.pieces_of(table["block"][0].as_py(), joined([x[2] for x in extended(table, answers)]), blocks)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        round_of = answers["round"].to_numpy()
        first, second = answers.filter(pa.array(round_of == 1)), answers.filter(pa.array(round_of == 2))
        docs_of = list(extended(table, first))
        again = c.answered(joined([x[2] for x in docs_of]), second, blocks)
        made = []
        parts = np.split(again, np.cumsum([len(x[2]) for x in docs_of])[:-1])
        for value, (size, starts, _), keep in zip(table[texts], docs_of, parts):
            found, gone = c.words(value.as_py()), covered(size, starts[keep], length)
            kept = b" ".join([w for w, x in zip(found, gone.tolist()) if not x]).decode("utf-8", "surrogatepass")
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            made.append((len(found), int(gone.sum()), kept, [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]))
        out = {f.name: table[f.name] for f in fields}
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for k, (name, kind) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", span))):
            out[name] = pa.array([m[k] for m in made], kind)
        return pa.table(out)

    first = c.stored(c.repeated_keys(base.groupBy("block").applyInArrow(ask_seeds, c.PIECES), c.FILTER_BYTES), "seeds")
    first = first.withColumn("round", F.lit(1))
    asked = base.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_extensions, c.PIECES)
    second = c.repeated_keys(asked).withColumn("round", F.lit(2))
    outputs = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    outputs.append(T.StructField("spans", T._parse_datatype_string("array<struct<start:bigint,end:bigint>>")))
    answers = first.unionByName(second)
    result = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, T.StructType(fields + outputs))
    return result.toDF(*names, "n_words", "n_removed", "kept", "spans")
