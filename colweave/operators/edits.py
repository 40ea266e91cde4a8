"""Review edits: a log of edits folded into the review rows.

The result is that of applying the edits of a row one after another in `seq` order. No log is gathered: everything but one
fact reduces to "the last edit of a kind". The exception is the last moment a row ran out of sources. Its sources at any
moment are a set that toggles change, and a set is followed by one number: the exclusive or of the hashes of its columns,
which is that of no columns only if none is left. So it is a prefix scan in two passes. The log is cut into chunks of
consecutive edits of a row and shuffled and sorted once, by row, chunk and `seq`. Most rows are one chunk; a row with a long
log is cut at quantiles of its sequence numbers, so that no chunk is much longer than a task's share. Of each chunk the last
edits and the toggles since its last unmapping are written, with the running value inside the chunk; the totals of a row's
chunks then give what each chunk starts from. Hashes have 128 bits.

Edits: request_id, target_column, seq (unique per row), action, payload (JSON text, see EDIT_PAYLOAD). Actions:
validate, rollback, unmap, toggle (column), set (match_type, confidence, rule). Other edits change nothing and are listed by
`rejected_edits`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.staging import stage, written
from colweave.functions.text import null_if_blank, trim_ws
from colweave.schemas import DEFAULT_MATCH_TYPE, EDIT_PAYLOAD

KEY = ["request_id", "target_column"]
FIELDS = ("source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")
ACTIONS = ("validate", "rollback", "unmap", "toggle", "set")
NEVER = -(2**63)
NO_SOURCES = "array<string>"
# Edits sampled to find where long logs are cut, in all and at least for each chunk.
SAMPLED, SAMPLED_PER_CHUNK = 1_000_000, 1_000


def _decoded(edits: DataFrame) -> DataFrame:
    return edits.withColumn("p", F.from_json("payload", EDIT_PAYLOAD))


def _fault() -> Column:
    """Why an edit cannot be applied; null if it can."""
    incomplete = F.col("request_id").isNull() | F.col("target_column").isNull() | F.col("seq").isNull()
    return (
        F.when(incomplete, "no row or sequence number")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "toggle") & F.col("p.column").isNull(), "no column to toggle")
    )


def rejected_edits(edits: DataFrame) -> DataFrame:
    """Edits that are not applied, with the reason."""
    return _decoded(edits).withColumn("reason", _fault()).filter(F.col("reason").isNotNull()).drop("p")


def _log(edits: DataFrame) -> DataFrame:
    """Edits that are applied: toggles with their column, settings with their payload, which is decoded only if it is the last."""
    column = F.when(F.col("action") == "toggle", F.from_json("payload", EDIT_PAYLOAD)["column"])
    used = edits.select(*KEY, "seq", "action", F.struct(column.alias("column")).alias("p"), F.when(F.col("action") == "set", F.col("payload")).alias("set"))
    # Staged, as a plain filter would make and decode payloads a second time.
    valid = stage(used, {"fault": _fault()}).filter(F.col("fault").isNull())
    return valid.select(*KEY, "seq", "action", F.col("p.column").alias("column"), "set")


def _setting(payload: Column) -> Column:
    p = F.from_json(payload, EDIT_PAYLOAD)
    return F.struct(
        F.coalesce(trim_ws(p["match_type"]), F.lit("")).alias("match_type"),
        _clamped(p["confidence"]).alias("confidence"),
        null_if_blank(p["rule"]).alias("rule"),
    )


def _clamped(percent: Column) -> Column:
    """Confidence of an edit: a percentage within 0 to 100, 0 for anything that is not a finite number."""
    finite = percent.isNotNull() & ~F.isnan(percent) & (F.abs(percent) < F.lit(float("inf")))
    return F.when(finite, F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def _hashes(column: Column) -> tuple[Column, Column]:
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def _both(first: Column, second: Column) -> Column:
    """Exclusive or of two pairs of hashes."""
    return F.struct(first["h1"].bitwiseXOR(second["h1"]).alias("h1"), first["h2"].bitwiseXOR(second["h2"]).alias("h2"))


def _set_hash(columns: Column) -> Column:
    distinct = F.array_distinct(F.coalesce(columns, F.array().cast(NO_SOURCES)))
    of = lambda i: F.aggregate(F.transform(distinct, lambda c: _hashes(c)[i]), F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h))
    return F.struct(of(0).alias("h1"), of(1).alias("h2"))


def _cuts(edits: DataFrame, chunks: int) -> DataFrame:
    """The rows whose edits lie in several chunks, by the hash of their key, and the sequence numbers their chunks end at.

    Chunks are laid end to end over the log, row after row, and the first chunk of a row begins at a place in it that depends
    on the hash. So a row is cut with a probability of its share of a chunk, always if it is longer, and about as many rows
    as there are chunks are cut. As for range partitioning, a sample finds the places; where they are changes no result.
    """
    n_edits = edits.count()
    share = max(1, math.ceil(n_edits / chunks))
    part = min(1.0, max(SAMPLED, SAMPLED_PER_CHUNK * chunks) / max(1, n_edits))
    keys = edits.filter(F.col("request_id").isNotNull() & F.col("target_column").isNotNull() & F.col("seq").isNotNull())
    keys = keys.select(F.xxhash64(*KEY).alias("row"), "seq")
    keys = written(keys.sample(part, 7), "sampled-edits") if part < 1 else keys
    begun, n = F.pmod("row", F.lit(share)), F.col("n") / part
    cut = keys.groupBy("row").agg(F.count("*").alias("n")).filter(begun + n > share)
    parts = max(chunks, 2)
    quantiles = F.percentile_approx("seq", [i / parts for i in range(1, parts)])
    at = lambda i: F.floor((begun + n * i / parts) / share)
    seqs = keys.join(F.broadcast(cut), "row").groupBy("row", "n").agg(quantiles.alias("quantiles"))
    return seqs.select("row", F.filter("quantiles", lambda q, i: at(i + 1) > at(i)).alias("ends"))


def _chunked(edits: DataFrame, chunks: int) -> DataFrame:
    """The log with the chunk of each edit, counted from 0 in each row."""
    log = _log(edits).withColumn("row", F.xxhash64(*KEY)).join(F.broadcast(_cuts(edits, chunks)), "row", "left")
    chunk = F.when(F.col("ends").isNotNull(), F.size(F.filter("ends", lambda end: end < F.col("seq")))).otherwise(0)
    return log.withColumn("chunk", chunk).drop("row", "ends")


def _scanned(edits: DataFrame, chunks: int | None) -> DataFrame:
    """What later steps need of each chunk: its last edit, those of each kind, and all toggles since it was last unmapped.

    `toggled` is the hash of a row's toggles since its chunk began. All windows share one shuffle and one sort.
    """
    log = _chunked(edits, chunks or int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunk = Window.partitionBy(*reversed(KEY), "chunk").orderBy("seq")  # targets first: they differ more, so they sort faster
    running, whole = (chunk.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    toggled = [F.bit_xor(F.when(F.col("action") == "toggle", h).otherwise(F.lit(0))).over(running) for h in _hashes(F.col("column"))]
    last = {action: F.max(F.when(F.col("action") == action, F.col("seq"))).over(whole).alias(f"last_{action}") for action in ("rollback", "unmap", "set")}
    log = log.select("*", F.struct(toggled[0].alias("h1"), toggled[1].alias("h2")).alias("toggled"), F.max("seq").over(whole).alias("last_edit"), *last.values())
    needed = (F.col("seq") == F.col("last_edit")) | ((F.col("action") == "toggle") & (F.col("seq") > F.coalesce("last_unmap", F.lit(NEVER))))
    for action in last:
        needed |= (F.col("action") == action) & (F.col("seq") == F.col(f"last_{action}"))
    log = log.filter(needed).select(*KEY, "chunk", "seq", "action", "column", F.when(F.col("action") == "set", _setting(F.col("set"))).alias("set"), "toggled")
    return written(log, "edits")


def apply_edits(rows: DataFrame, edits: DataFrame, chunks: int | None = None) -> DataFrame:
    """Review rows after their edits; rows without edits are kept as they are.

    `chunks` sets how many chunks the log would make if it were that of one row, and so how long a chunk may be; by default as
    many as the session has shuffle partitions.
    """
    log = _scanned(edits, chunks)
    based = written(_base_rows(rows, log), "edited-rows")
    toggles = log.filter(F.col("action") == "toggle").select(*KEY, "chunk", "seq", "column", "toggled")
    # Both sides grow with the log, and the files are much smaller than their rows: never broadcast.
    since = based.filter("last_toggle is not null").select(*KEY, "reset_seq", "goal", "starts").hint("merge")
    toggles = toggles.join(since, KEY).filter(F.col("seq") > F.coalesce("reset_seq", F.lit(NEVER)))
    # A row is without sources where all toggles so far undo its base list: where the hash so far is the goal.
    start = F.element_at(F.filter("starts", lambda x: x["chunk"] == F.col("chunk")), 1)["toggled"]
    empty = _both(start, F.col("toggled")) == F.col("goal")
    per_column = toggles.groupBy(*KEY, "column").agg(F.count("*").alias("n"), F.max("seq").alias("seq"), F.max(F.when(empty, F.col("seq"))).alias("emptied_seq"))
    changed = per_column.groupBy(*KEY).agg(F.collect_list(F.struct("seq", "column", "n")).alias("changed"), F.max("emptied_seq").alias("emptied_seq"))
    folded = based.join(changed, KEY, "left")
    # Columns that were toggled leave the base list; those present in the end follow in the order they were added.
    touched = F.transform("changed", lambda x: x["column"])
    present = lambda x: (F.array_contains("base_source_columns", x["column"]).cast("int") + x["n"]) % 2 == 1
    added = F.transform(F.array_sort(F.filter("changed", present)), lambda x: x["column"])
    kept = F.filter("base_source_columns", lambda c: ~F.array_contains(touched, c))
    return folded.withColumn("toggled_sources", F.concat(kept, added)).select(*_final_columns(rows.columns))


def _base_rows(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Each row as its last reset left it (untouched, rolled back to its original, or unmapped), and its last edits since.

    A rollback of a row without an original resets nothing but the status. Totals of chunks are added up by row: `starts`
    holds the hash of all toggles before each chunk, `goal` that of the toggles up to the reset and the base list, which
    the hash so far equals whenever no source is left.
    """
    at = lambda action: F.max(F.when(F.col("action") == action, F.struct("seq", "toggled")))
    totals = log.groupBy(*KEY, "chunk").agg(
        at("rollback").alias("rollback"),
        at("unmap").alias("unmap"),
        F.max(F.when(F.col("action") == "toggle", F.col("seq"))).alias("toggle_seq"),
        F.max(F.when(F.col("action") == "set", F.struct("seq", "set"))).alias("any_set"),
        F.max(F.struct("seq", "action", "toggled")).alias("last_edit"),
    )
    earlier = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(f"last_edit.toggled.{h}").over(earlier), F.lit(0)).alias(h) for h in ("h1", "h2")]
    totals = totals.withColumn("start", F.struct(*before))
    reset = lambda name: F.max(F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.seq").alias("seq"), _both(F.col("start"), F.col(f"{name}.toggled")).alias("toggled"))))
    by_row = totals.groupBy(*KEY).agg(
        reset("rollback").alias("rollback"),
        reset("unmap").alias("unmap"),
        F.max("toggle_seq").alias("toggle_seq"),
        F.max("any_set").alias("any_set"),
        F.max("last_edit").alias("last_edit"),
        F.collect_list(F.struct("chunk", F.col("start").alias("toggled"))).alias("starts"),
    )
    joined = rows.join(by_row, KEY, "left")
    rollback = F.when(F.col("original").isNotNull(), F.col("rollback"))
    rolled = F.coalesce(rollback["seq"] > F.coalesce("unmap.seq", F.lit(NEVER)), F.lit(False))
    joined = joined.withColumn("rolled", rolled).withColumn("reset", F.when(F.col("rolled"), F.col("rollback")).otherwise(F.col("unmap")))
    since = F.coalesce("reset.seq", F.lit(NEVER))

    def base(name: str, cleared: Column) -> Column:
        return F.when(F.col("rolled"), F.col(f"original.{name}")).when(F.col("reset").isNotNull(), cleared).otherwise(F.col(name))

    nothing, zero = F.lit(None).cast("string"), F.struct(F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"))
    cleared = {"source_columns": F.array().cast(NO_SOURCES), "confidence_score": F.lit(0.0), "match_type": F.lit(""), "reasoning": nothing, "transformation_rule": nothing}
    return joined.select(
        *rows.columns,
        F.col("reset.seq").alias("reset_seq"),
        F.col("last_edit.action").alias("last_action"),
        F.when(F.col("any_set.seq") > since, F.col("any_set")).alias("last_set"),
        F.when(F.col("toggle_seq") > since, F.col("toggle_seq")).alias("last_toggle"),
        "starts",
        _both(F.coalesce("reset.toggled", zero), _set_hash(base("source_columns", cleared["source_columns"]))).alias("goal"),
        *[base(name, cleared[name]).alias(f"base_{name}") for name in FIELDS],
    )


def _final_columns(names: list[str]) -> list[Column]:
    """Last setting wins unless the row ran out of sources after it; a later toggle gives a blank type the default."""
    last_set, emptied = F.col("last_set"), F.col("emptied_seq")
    set_wins = F.coalesce(F.col("last_set.seq") > emptied, last_set.isNotNull())
    cleared = emptied.isNotNull()
    def settle(setting: Column, blank: Column, base: str) -> Column:
        return F.when(set_wins, setting).when(cleared, blank).otherwise(F.col(base))

    nothing = F.lit(None).cast("string")
    match_type = settle(F.col("last_set.set.match_type"), F.lit(""), "base_match_type")
    # A toggle that leaves sources turns a blank type into the default; settings and clears before it are covered.
    toggled_last = F.col("last_toggle") > F.greatest(F.coalesce("last_set.seq", F.lit(NEVER)), F.coalesce(emptied, F.lit(NEVER)))
    match_type = F.when(F.coalesce(toggled_last, F.lit(False)) & (F.coalesce(match_type, F.lit("")) == ""), DEFAULT_MATCH_TYPE).otherwise(match_type)
    final = {
        "source_columns": F.coalesce("toggled_sources", "base_source_columns"),
        "confidence_score": settle(F.col("last_set.set.confidence"), F.lit(0.0), "base_confidence_score"),
        "match_type": match_type,
        "reasoning": F.when(cleared, nothing).otherwise(F.col("base_reasoning")),
        "transformation_rule": settle(F.col("last_set.set.rule"), nothing, "base_transformation_rule"),
        "status": F.when(F.col("last_action").isNull(), F.col("status"))
        .when(F.col("last_action") == "validate", "validated")
        .otherwise("pending"),
    }
    return [final[c].alias(c) if c in final else F.col(c) for c in names]
