"""Repairing the structure of conversations by the cheapest edits, streamed in the order of turns.

Rows are dealt by conversation and sorted by turn, and mapInPandas reads them once. For each conversation it carries, from
one Arrow batch to the next, the least cost of every state of the role grammar `(s?(ua)+)?` and the order of the edit
strings that reach them. A step depends only on the differences of the costs, that order and the kind of row, so steps are
worked out once and looked up afterwards. What a step chose is one word of 24 bits a row; words of giant conversations are
spilled to the folder that all executors share and read back from their end, so a task never holds a conversation.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert an empty user or
assistant row 3; a truncated row that stays adds 3. Of the cheapest repairs the one with the least string of initials is
taken. Initials determine the repair: from every state, each of D, I, K and R leads to one state only.

The texts of a repair are made by a second pass in the same order, which reads each conversation's edits before its rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm import common as c

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, REPAIR = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: States of the grammar: nothing yet, after s, after u, after a. NEXT[state][initial] is the state after a row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What an inserted or reroled row becomes in each state, and the state after it.
MADE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ENDS = (EMPTY, ASSISTANT)
EDITS = "DKR"


@dataclass(frozen=True)
class Settings:
    """After spill_rows rows of one conversation, its step words go to the shared folder."""

    spill_rows: int = 1 << 20


# ---- rows in order --------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by the CRC of id and turn; a null shows as one space."""
    shown = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), fate.alias("fate")).where("fate <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side in one partition, by turn (nulls first), role and text, with their faults.

    A row repeats an earlier one if its role and text were seen in an earlier turn, or in the row just before it: equal
    rows of one turn are neighbours. The first turn of a repeated text comes from an aggregate over digests, so no task
    remembers the texts of a conversation.
    """
    slim = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    slim = slim.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    ordered = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_turn"))
    seen = slim.groupBy("conv_id", "digest").agg(F.min(ordered).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("seen_conv"), F.col("digest").alias("seen_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("digest") == F.col("seen_digest"))
    out = slim.join(seen, same, "left")
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(3)
    repeats = F.when(F.col("first").isNull(), 0).when(F.col("turn").eqNullSafe(F.col("first.first_turn")), 1).otherwise(2)
    out = out.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"), repeats.alias("repeats"))
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


# ---- the cheapest edits ---------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def moves(initial: str, fault: int) -> list[list[tuple[int, int, str, str]]]:
    """For each state after a row: (state before, cost, inserted before it and the row's own edit, in initials)."""
    out: list[list[tuple[int, int, str, str]]] = [[] for _ in NEXT]
    for before in range(4):
        state, inserts = before, 0
        while inserts < 3:
            spent = INSERT * inserts
            out[state].append((before, spent + DELETE, "I" * inserts, "D"))
            if fault in (0, 3):
                stays = spent + (REPAIR if fault == 3 else 0)
                if initial in NEXT[state]:
                    out[NEXT[state][initial]].append((before, stays + KEEP, "I" * inserts, "K"))
                out[MADE[state][1]].append((before, stays + REROLE, "I" * inserts, "R"))
            state, inserts = MADE[state][1], inserts + 1
    return out


@lru_cache(maxsize=1 << 16)
def step(costs: tuple[int, ...], ranks: tuple[int, ...], initial: str, fault: int):
    """One row: (costs less their minimum, that minimum, ranks, step word).

    ranks order the states' edit strings. These end in a row's edit, so none begins another, and a candidate compares by
    the rank it comes from, then by what it adds. The word has six bits a state: the state before it, the inserts and the
    row's own edit.
    """
    chosen = []
    for options in moves(initial, fault):
        found = [(costs[b] + spent, ranks[b], inserted + own, b, len(inserted)) for b, spent, inserted, own in options if costs[b] < NEVER]
        chosen.append(min(found, default=None))
    low = min(x[0] for x in chosen if x)
    order = {x[1:3]: i for i, x in enumerate(sorted((x for x in chosen if x), key=lambda x: x[1:3]))}
    word = sum((x[3] | x[4] << 2 | EDITS.index(x[2][-1]) << 4) << (6 * state) for state, x in enumerate(chosen) if x)
    costs = tuple(x[0] - low if x else NEVER for x in chosen)
    return costs, low, tuple(order[x[1:3]] if x else 0 for x in chosen), word, tuple((x[3], x[4], x[2][-1]) if x else None for x in chosen)


START = ((0, NEVER, NEVER, NEVER), (0, 0, 0, 0))


def ending(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, int, int]:
    """(cost, state, inserts) of the best way to end."""
    found = []
    for before in range(4):
        state = before
        for inserts in range(3):
            if costs[before] < NEVER and state in ENDS:
                found.append((costs[before] + INSERT * inserts, ranks[before], inserts, before))
            state = MADE[state][1]
    cost, _, inserts, state = min(found)
    return cost, state, inserts


class Words:
    """Step words of one conversation: the latest in memory, earlier ones in a file of the shared folder."""

    def __init__(self, folder: str, spill_rows: int):
        self.folder, self.most, self.recent, self.spilled = folder, spill_rows, [], []

    def add(self, word: int) -> None:
        self.recent.append(word)
        if len(self.recent) >= self.most:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
            path = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
            system.create_dir(at, recursive=True)
            with system.open_output_stream(path) as f:
                f.write(np.array(self.recent, "<u4").tobytes())
            self.spilled.append((system, path))
            self.recent = []

    def backwards(self) -> Iterator[int]:
        """The words from the last to the first; files go as they have been read."""
        yield from reversed(self.recent)
        while self.spilled:
            system, path = self.spilled.pop()
            with system.open_input_stream(path) as f:
                words = np.frombuffer(f.read(), "<u4")
            system.delete_file(path)
            yield from reversed(words.tolist())


class Conversation:
    """What is carried along one conversation."""

    def __init__(self, words: Words):
        self.costs, self.ranks = START
        self.base = 0
        self.words = words
        self.hashes = [hashlib.sha256(), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.before = self.previous = None

    def add(self, turn: int | None, role: str, text: str, digest: str, fault: int, repeats: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        own = (turn, digest)
        if fault != 1 and (repeats == 2 or repeats == 1 and self.before == own):
            fault = 2
        self.turn, self.before = turn, own
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        initial = role[:1]
        if self.previous is not None:
            self.illegal += self.previous + initial not in ("su", "ua", "au")
        self.previous = initial
        self.costs, low, self.ranks, word, chosen = step(self.costs, self.ranks, initial if initial in "sua" else "", fault)
        self.base += low
        self.words.add(word)
        kept, after = None, [None] * 4
        for state, way in enumerate(chosen):
            if way is None:
                continue
            before, inserts, edit = way
            h = self.hashes[before].copy()
            at = _inserted(h, before, inserts)
            if edit != "D":
                kept = kept if kept is not None else f":{text}".encode("utf-8", "surrogatepass")
                name = role if edit == "K" else MADE[at][0]
                h.update((b"" if at == EMPTY else b"\n") + name.encode("utf-8", "surrogatepass"))
                h.update(kept)
            after[state] = h
        self.hashes = after

    def end(self, conv_id) -> tuple:
        cost, state, inserts = ending(self.costs, self.ranks)
        h = self.hashes[state].copy()
        _inserted(h, state, inserts)
        audit = ["I" * inserts]
        for word in self.words.backwards():
            way = word >> (6 * state)
            audit.append("I" * (way >> 2 & 3) + EDITS[way >> 4 & 3])
            state = way & 3
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.base + cost)
        return (conv_id, *counts, "".join(reversed(audit)), h.hexdigest())


def _inserted(h, state: int, inserts: int) -> int:
    """Adds inserted rows to the hash of a repair that is in this state; returns the state after them."""
    for _ in range(inserts):
        name, after = MADE[state]
        h.update(f"{'' if state == EMPTY else chr(10)}{name}:".encode())
        state = after
    return state


FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def audits(ordered: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """One row for each conversation of rows in order: faults, cost and edits of its cheapest repair, hash of its rows.

    Ids come as text, with their absence apart, so that neither a null nor a large id is rounded.
    """

    def run(frames):
        columns = ["key", *[x.split()[0] for x in FOUND.split(", ")]]
        at, carried, done = None, None, []
        for frame in frames:
            names = ("role", "text", "digest", "fault", "repeats")
            for key, turn, *row in zip(frame["key"], _turns(frame), *(frame[x] for x in names)):
                if carried is None or key != at:
                    if carried is not None:
                        done.append(carried.end(at))
                    at, carried = key, Conversation(Words(folder, settings.spill_rows))
                carried.add(turn, *row)
            yield _frame(done, columns)
            done = []
        if carried is not None:
            yield _frame([carried.end(at)], columns)

    keyed = ordered.select(_key("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "digest", "fault", "repeats")
    return keyed.mapInPandas(run, f"key string, {FOUND}")


def _key(name: str) -> Column:
    """An id as text that tells a null from all others."""
    return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(name).cast("string"))).alias("key")


def _turns(frame: pd.DataFrame) -> list:
    return [None if t is None else int(t) for t in frame["turn"]]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([list(r) for r in rows], columns=columns, dtype=object)


def repair(rows: DataFrame, originals: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """conv_id, counts of faults, cost, audit and repaired_sha256 for every conversation of `originals` (default: of rows).

    Rows need conv_id, turn, role and text; other columns are ignored. A null role or text counts as one space. Rows are
    told apart by what they hold, so repeated rows are duplicates of the first. Rows without an id are a conversation of
    their own, with a null id. An empty role has no initial and can only be reroled or deleted. Turns are whole numbers;
    gaps that no 64-bit integer holds are null. A conversation of `originals` without rows has zeros, an empty audit and
    the hash of nothing. An empty table gives no rows.
    """
    folder = c.scratch(rows.sparkSession, "conversations")
    shown = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = audits(in_order(shown), folder, settings)
    ids = (rows if originals is None else originals).select("conv_id").distinct()
    out = ids.withColumn("key", _key("conv_id")).join(found, "key", "left").drop("key")
    numbers = [F.coalesce(x, F.lit(0)).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.col("audit").isNull()
    gaps = F.when(none, 0).otherwise(F.col("gaps")).cast("bigint").alias("gaps")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return out.select("conv_id", gaps, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)


# ---- the repaired rows ----------------------------------------------------------------------------------------------


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, position from 1, role, text, edit: K, R or I) of every repaired conversation.

    `repairs` is what `repair` returned for these rows. Edits come before the rows of their conversation and are applied
    row by row; they are the only thing held, a byte for each row.
    """
    shown = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    shown = shown.select(_key("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    edits = repairs.select(_key("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    ordered = edits.unionByName(shown).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "text")

    def run(frames):
        state, position, audit, at, key = EMPTY, 0, "", 0, None
        columns = ["key", "position", "role", "text", "edit"]
        for frame in frames:
            out = []

            def emit(role, text, edit):
                nonlocal position
                position += 1
                out.append((key, position, role, text, edit))

            def inserts():
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    emit(MADE[state][0], "", "I")
                    state, at = MADE[state][1], at + 1

            for own, kind, role, text in zip(frame["key"], frame["kind"], frame["role"], frame["text"]):
                if kind == 0:
                    key, state, position, audit, at = own, EMPTY, 0, text, 0
                    inserts()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    role = role if edit == "K" else MADE[state][0]
                    state = NEXT[state][role[:1]]
                    emit(role, text, edit)
                inserts()
            yield _frame(out, columns)

    made = ordered.drop("turn").mapInPandas(run, "key string, position bigint, role string, text string, edit string")
    ids = repairs.select("conv_id", _key("conv_id"))
    return ids.join(made, "key").drop("key")
