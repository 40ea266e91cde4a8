"""Reply chunks and progress events: batch folds, and the same folds over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.json_text import strict_json
from colweave.functions.text import trim_ws, utf16_length

KNOWN_EVENTS = ("progress", "token", "result", "error")
FINAL_EVENTS = ("result", "error")
NO_RESULT = "no result"
CHUNKS_PER_PART = 65_536


def non_empty(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.coalesce("payload", F.lit("")) != "")


def _joined(column: str) -> Column:
    """Payloads in sequence order as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda c: c[column]), "")


def fold_parts(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Text of every request in parts of consecutive chunks; holds for replies of any length."""
    part = F.floor(F.col("seq") / chunks_per_part).alias("part")
    return non_empty(chunks).groupBy("request_id", part).agg(
        F.count("*").alias("n_chunks"),
        F.sum(utf16_length(F.col("payload"))).cast("bigint").alias("n_chars"),
        _joined("payload").alias("text"),
    )


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """Complete reply of every request, with its number of chunks and characters.

    Chunks are joined into parts first, so no group gathers more chunks than a part and then more parts than a reply has.
    A reply is one text; one that a string cannot hold fails the query.
    """
    parts = fold_parts(chunks).withColumnRenamed("part", "seq")
    return parts.groupBy("request_id").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), _joined("text").alias("reply_text"))


def complete_replies(events: DataFrame) -> DataFrame:
    """Whether each request has as many events as sequence numbers from its first to its last."""
    counted = F.count("*") == F.max("seq") - F.min("seq") + 1
    return events.groupBy("request_id").agg(counted.alias("complete"))


def _first_final() -> Column:
    return F.min(F.when(F.col("event_type").isin(*FINAL_EVENTS), F.struct("seq", "event_type", "payload")))


def request_outcomes(events: DataFrame) -> DataFrame:
    """How each request ended: its first result or error, or no result. One row per request leaves each map task."""
    ended = events.groupBy("request_id").agg(_first_final().alias("final"))
    return ended.select(
        "request_id", F.coalesce("final.event_type", F.lit(NO_RESULT)).alias("outcome"), F.col("final.payload").alias("payload")
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Last progress detail of each request."""
    last = F.max(F.struct("seq", "payload"))
    progress = events.filter(F.col("event_type") == "progress")
    return progress.groupBy("request_id").agg(last.alias("last")).select("request_id", "last.seq", F.col("last.payload").alias("detail"))


def decode_event_text(texts: DataFrame) -> DataFrame:
    """Events of `event: name` / `data: json` text, one row per data line, from one text per request.

    A data line takes the name of the event line right before it among the lines that matter. Data that is not JSON is
    dropped; an unknown name is kept and marked.
    """
    lines = F.filter(F.transform(F.split("event_text", "\n"), trim_ws), lambda s: s.startswith("event: ") | s.startswith("data: "))
    # One leading slot makes the line before the first one empty.
    padded = texts.withColumn("_lines", F.concat(F.array(F.lit("")), lines))
    previous = lambda i: F.get("_lines", i - 1)
    named = F.transform(
        "_lines",
        lambda s, i: F.when(
            s.startswith("data: "),
            F.struct(
                F.when(previous(i).startswith("event: "), trim_ws(F.substring(previous(i), 8, 2**31 - 1))).otherwise("").alias("event_type"),
                F.substring(s, 7, 2**31 - 1).alias("data"),
            ),
        ),
    )
    found = F.filter(named, lambda e: e.isNotNull())
    rows = padded.select("request_id", F.posexplode(found).alias("seq", "event"))
    parsed = rows.select("request_id", F.col("seq").cast("bigint").alias("seq"), "event.event_type", strict_json(F.col("event.data")).alias("data"))
    return parsed.filter(F.col("data").isNotNull()).withColumn("known", F.col("event_type").isin(*KNOWN_EVENTS))


def event_payloads(decoded: DataFrame) -> DataFrame:
    """Decoded events in the form the folds take: the token text, progress detail, error text, or the whole result."""
    kind = F.col("event_type")
    pick = lambda name: F.coalesce(F.try_variant_get("data", f"$.{name}", "string"), F.lit(""))
    payload = (
        F.when(kind == "token", pick("token"))
        .when(kind == "progress", pick("detail"))
        .when(kind == "error", F.coalesce(F.try_variant_get("data", "$.error", "string"), F.lit("Unknown server error")))
        .otherwise(F.to_json("data"))
    )
    return decoded.filter("known").select("request_id", "seq", "event_type", payload.alias("payload"))


def _merged_runs(chunks: Column) -> Column:
    """Chunks with their sequence numbers as texts of runs of consecutive numbers, by first number."""
    ordered = F.array_sort(chunks)
    run_of = lambda c, i: c["seq"] - i
    starts = F.array_distinct(F.transform(ordered, run_of))

    def text(run: Column) -> Column:
        own = F.filter(ordered, lambda c, i: run_of(c, i) == run)
        return F.struct(F.element_at(own, 1)["seq"].alias("seq"), F.array_join(F.transform(own, lambda c: c["payload"]), "").alias("payload"))

    return F.array_sort(F.transform(starts, text))


def stream_parts(events: DataFrame, part: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """First streaming step: what each request sent in each time window, emitted when the watermark passes its end.

    The state holds the chunks of windows still open, whatever the length of a reply. Chunks later than the watermark are
    left out; counts of what arrived show it later.
    """
    token = (F.col("event_type") == "token") & (F.coalesce("payload", F.lit("")) != "")
    parts = (
        events.withWatermark("ts", delay)
        .groupBy("request_id", F.window("ts", part).alias("part"))
        .agg(
            F.count("*").alias("n_events"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count_if(token).alias("n_chunks"),
            F.coalesce(F.sum(F.when(token, utf16_length(F.col("payload")))), F.lit(0)).cast("bigint").alias("n_chars"),
            F.collect_list(F.when(token, F.struct("seq", "payload"))).alias("chunks"),
            _first_final().alias("final"),
            F.max(F.when(F.col("event_type") == "progress", F.struct("seq", "payload"))).alias("progress"),
        )
    )
    return parts.withColumn("runs", _merged_runs(F.col("chunks"))).withColumn("at", F.window_time("part")).drop("chunks")


def fold_stream(events: DataFrame, gap: str = "10 minutes", delay: str = "1 minute", part: str = "1 minute") -> DataFrame:
    """Streaming form of the folds: one row per request once it has been quiet for `gap`.

    `events` is a streaming DataFrame (request_id, seq, event_type, payload, ts). Two stateful steps follow each other:
    chunks to parts by time window, parts to requests by session. A part is a few texts of consecutive chunks, so chunks
    that arrive out of order are put in place across parts, and the state of a request holds its parts. A pause longer
    than the gap splits a reply, so set the gap above the longest pause expected.

    `complete` says whether as many events arrived as there are sequence numbers from the first to the last: a reply that
    lost a chunk, or has one twice, is not.
    """
    folded = (
        stream_parts(events, part, delay)
        .groupBy("request_id", F.session_window("at", gap).alias("session"))
        .agg(
            F.sum("n_chunks").alias("n_chunks"),
            F.sum("n_chars").alias("n_chars"),
            (F.sum("n_events") == F.max("last_seq") - F.min("first_seq") + 1).alias("complete"),
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.min("final").alias("final"),
            F.max("progress").alias("progress"),
        )
    )
    return folded.select(
        "request_id",
        F.col("session.start").alias("started"),
        F.col("session.end").alias("closed"),
        "n_chunks",
        "n_chars",
        "complete",
        F.array_join(F.transform("runs", lambda c: c["payload"]), "").alias("reply_text"),
        F.coalesce("final.event_type", F.lit(NO_RESULT)).alias("outcome"),
        F.col("progress.payload").alias("detail"),
    )


def early_outcomes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming outcomes at once: a request leaves with the first result or error that arrives.

    The state holds ids of ended requests for the delay, within which the same request is not reported again; neither
    tokens nor progress reach it.
    """
    final = events.filter(F.col("event_type").isin(*FINAL_EVENTS)).withWatermark("ts", delay)
    return final.dropDuplicatesWithinWatermark(["request_id"]).select("request_id", F.col("event_type").alias("outcome"), "payload", "ts")


def outcome_stream(events: DataFrame, gap: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Outcome and last progress of each request once it has been quiet for `gap`, also of those without a result.

    Token texts are dropped before the state, which holds one final and one progress event for each open request.
    """
    kind = F.col("event_type")
    slim = events.select("request_id", "seq", "event_type", F.when(kind != "token", F.col("payload")).alias("payload"), "ts")
    folded = slim.withWatermark("ts", delay).groupBy("request_id", F.session_window("ts", gap).alias("session")).agg(
        _first_final().alias("final"), F.max(F.when(kind == "progress", F.struct("seq", "payload"))).alias("progress")
    )
    return folded.select(
        "request_id",
        F.col("session.start").alias("started"),
        F.coalesce("final.event_type", F.lit(NO_RESULT)).alias("outcome"),
        F.col("final.payload").alias("payload"),
        F.col("progress.payload").alias("detail"),
    )


def write_folds(folded: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append finished requests to Parquet, exactly once; the checkpoint folder must be shared by all executors."""
    writer = folded.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
