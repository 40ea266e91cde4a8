"""Queries over reply chunks and events, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colweave.session import shared_folder
from colweave.streaming import chunks
from workloads.standins import table


def conversation_chunks(spark, sf):
    """Turns as chunks of one reply per conversation, and an empty chunk after every fifth turn."""
    c = table(spark, sf, "conversations")
    gaps = c.filter((F.col("conv_id") + F.col("turn")) % 5 == 0).withColumn("text", F.lit(""))
    c = c.withColumn("turn", F.col("turn") * 2).unionByName(gaps.withColumn("turn", F.col("turn") * 2 + 1))
    payload = F.col("text")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3 + F.col("turn"))
    return c.select(
        F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("bigint").alias("seq"), F.lit("token").alias("event_type"), payload.alias("payload"), ts.alias("ts")
    )


CHUNKS = """c AS (SELECT CAST(conv_id AS VARCHAR) AS request_id, turn AS seq, text AS payload FROM conversations)"""


def _digested(folded):
    return folded.select("request_id", "n_chunks", "n_chars", F.md5("reply_text").alias("digest"))


def t1_fold_chunks(spark, sf):
    return _digested(chunks.fold_chunks(conversation_chunks(spark, sf)))


T1 = f"""WITH {CHUNKS} SELECT request_id, count(*) AS n_chunks, CAST(sum(length(payload)) AS BIGINT) AS n_chars, md5(string_agg(payload, '' ORDER BY seq)) AS digest
FROM c WHERE payload <> '' GROUP BY 1"""


EVENT_COLUMNS = ("request_id", "seq", "event_type", "payload")


def _closing(landed):
    """One event long after all others, which closes every window."""
    late = ("closing", 0, "token", "x", "2100-01-01")
    kinds = ("string", "bigint", "string", "string", "timestamp")
    return landed.limit(1).select(*[F.lit(v).cast(kind).alias(name) for v, kind, name in zip(late, kinds, (*EVENT_COLUMNS, "ts"))])


def _streamed(spark, arrivals, fold):
    """What a fold makes of a stream in which the tables arrive one after the other, and then a closing event.

    Files land in the shared folder. Of several tables each is a batch of its own, however many files it has, so later
    tables meet the watermark of earlier ones: the stream is resumed from its checkpoint when the next has landed.
    """
    base = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    landing = (*arrivals, _closing(arrivals[0]))
    for n, rows in enumerate(landing, 1):
        rows.select(*EVENT_COLUMNS, F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{base}/in")
        if len(arrivals) > 1 or n == len(landing):
            stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
            chunks.write_folds(fold(stream), f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").filter("request_id <> 'closing'")


def t1_stream_fold(spark, sf):
    return _digested(_streamed(spark, [conversation_chunks(spark, sf)], chunks.fold_stream).filter(F.col("n_chunks") > 0))


def _arriving(spark, sf):
    """Turns as chunks that arrive in three tables: odd turns, even turns, and long after them a few that were held up.

    Two markers lie between: an event moves the watermark for the batch after the next.
    """
    c = table(spark, sf, "conversations")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 600 + F.col("turn") * 20)
    c = c.select(
        F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("bigint").alias("seq"), F.lit("token").alias("event_type"), F.col("text").alias("payload"), ts.alias("ts"),
        ((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1)).alias("held_up"), F.col("turn") % 2,
    )
    marker = c.limit(1).select(F.lit("marker").alias("request_id"), F.lit(0).cast("bigint").alias("seq"), "event_type", F.lit("").alias("payload"), F.lit("2030-01-01").cast("timestamp").alias("ts"))
    on_time = c.filter(~F.col("held_up"))
    odd = F.col("(turn % 2)") == 1
    return [on_time.filter(odd).coalesce(4), on_time.filter(~odd).coalesce(4), marker, marker, c.filter("held_up").coalesce(4)]


def t1_out_of_order_stream(spark, sf):
    """Chunks out of order are put in place; a reply whose chunk came after the watermark is marked."""
    fold = lambda stream: chunks.fold_stream(stream, gap="30 minutes", delay="1 hour")
    folded = _streamed(spark, _arriving(spark, sf), fold).filter("request_id <> 'marker'")
    return folded.select("request_id", "n_chunks", "n_chars", "complete", F.md5("reply_text").alias("digest"))


T1_LATE = """SELECT CAST(conv_id AS VARCHAR) AS request_id, count(*) FILTER (text <> '') AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  count(*) = max(turn) - min(turn) + 1 AS complete, md5(string_agg(text, '' ORDER BY turn)) AS digest
FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 1) GROUP BY 1"""


def t2_t4_stream_outcomes(spark, sf):
    """Outcome and last progress of every request, from a stream of its events."""
    fold = lambda stream: chunks.outcome_stream(stream, gap="3650 days")
    return _streamed(spark, [user_events(spark, sf)], fold).select("request_id", "outcome", "detail")


def t2_early_outcomes(spark, sf):
    """Requests with an end, from a stream in which every end arrives twice."""
    c = table(spark, sf, "conversations")
    request, ts = F.col("conv_id").cast("string").alias("request_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 600 + F.col("turn")).alias("ts")
    tokens = c.select(request, F.col("turn").cast("bigint").alias("seq"), F.lit("token").alias("event_type"), F.col("text").alias("payload"), ts)
    ends = c.filter("turn = 0 and conv_id % 5 <> 4")
    kind = F.when(F.col("conv_id") % 5 == 0, "error").otherwise("result")
    ends = ends.select(request, F.lit(99).cast("bigint").alias("seq"), kind.alias("event_type"), F.concat(F.lit("end of "), F.col("conv_id").cast("string")).alias("payload"), ts)
    return _streamed(spark, [tokens.unionByName(ends), ends], chunks.early_outcomes).select("request_id", "outcome", "payload")


T2_EARLY = """SELECT CAST(conv_id AS VARCHAR) AS request_id, CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'result' END AS outcome, 'end of ' || conv_id AS payload
FROM conversations WHERE turn = 0 AND conv_id % 5 <> 4"""


def user_events(spark, sf):
    """Events of users as the events of requests: purchases end a request well, errors end it badly."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "progress").otherwise("token")
    request = F.concat_ws("-", F.col("user_id").cast("string"), (F.floor(F.col("value"))).cast("string"))
    return e.select(request.alias("request_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.col("props").alias("payload"), "ts")


EVENTS = """e AS (SELECT user_id || '-' || CAST(floor(value) AS BIGINT) AS request_id, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' WHEN 'view' THEN 'progress' ELSE 'token' END AS kind, props FROM events)"""


def t2_request_outcomes(spark, sf):
    return chunks.request_outcomes(user_events(spark, sf))


T2 = f"""WITH {EVENTS} SELECT request_id, coalesce(arg_min(kind, seq) FILTER (WHERE kind IN ('result', 'error')), 'no result') AS outcome,
  arg_min(props, seq) FILTER (WHERE kind IN ('result', 'error')) AS payload FROM e GROUP BY 1"""


def t4_latest_progress(spark, sf):
    return chunks.latest_progress(user_events(spark, sf))


T4 = f"WITH {EVENTS} SELECT request_id, max(seq) AS seq, arg_max(props, seq) AS detail FROM e WHERE kind = 'progress' GROUP BY 1"


def t3_decode_events(spark, sf):
    """Each event as event text: a token, a broken data line, a data line without a name, and the event itself."""
    e = table(spark, sf, "events")
    text = F.concat(
        F.lit('event: token\ndata: {"token":"a b"}\n\nevent: progress\ndata: {broken\n\ndata: {"x":1}\n\n event: '), F.col("event_type"),
        F.lit("\n\nevent: "), F.when(F.col("event_type") == "purchase", "result").otherwise(F.col("event_type")), F.lit("\r\ndata: "), F.col("props"), F.lit("\n: comment\n"),
    )
    decoded = chunks.decode_event_text(e.select(F.col("event_id").alias("request_id"), text.alias("event_text")))
    return decoded.select("request_id", "seq", "event_type", "known", F.try_variant_get("data", "$.k", "bigint").alias("k"), F.try_variant_get("data", "$.token", "string").alias("token"))


T2_T4 = f"""WITH {EVENTS} SELECT request_id, coalesce(arg_min(kind, seq) FILTER (WHERE kind IN ('result', 'error')), 'no result') AS outcome,
  arg_max(props, seq) FILTER (WHERE kind = 'progress') AS detail FROM e GROUP BY 1"""

T3 = """SELECT event_id AS request_id, CAST(0 AS BIGINT) AS seq, 'token' AS event_type, true AS known, CAST(NULL AS BIGINT) AS k, 'a b' AS token FROM events
UNION ALL SELECT event_id, 2, '', false, NULL, NULL FROM events
UNION ALL SELECT event_id, 3, CASE event_type WHEN 'purchase' THEN 'result' ELSE event_type END, event_type IN ('purchase', 'error'), CAST(props->>'$.k' AS BIGINT), NULL FROM events"""

QUERIES = {
    "t1_fold_chunks": (t1_fold_chunks, T1),
    "t1_stream_fold": (t1_stream_fold, T1),
    "t1_out_of_order_stream": (t1_out_of_order_stream, T1_LATE),
    "t2_early_outcomes": (t2_early_outcomes, T2_EARLY),
    "t2_request_outcomes": (t2_request_outcomes, T2),
    "t2_t4_stream_outcomes": (t2_t4_stream_outcomes, T2_T4),
    "t3_decode_events": (t3_decode_events, T3),
    "t4_latest_progress": (t4_latest_progress, T4),
}
