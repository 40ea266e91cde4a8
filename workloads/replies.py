"""Queries over reply normalisation: every reply shape the normaliser knows, written from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.operators import replies
from workloads.standins import table

ITEMS_PER_REPLY = 8


def _item_text():
    """JSON text of one item; six shapes by key."""
    key = F.col("p_partkey").cast("string")
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    word, first = F.element_at(F.split("p_name", " "), 2), F.split("p_name", " ")[0]
    shape = F.col("p_partkey") % 6

    def text(pattern, *args):
        return F.format_string(pattern, *args)

    return (
        F.when(shape == 0, text(
            '{"source_table":"%s","source_columns":["%s","x.y",""],"target_table":"%s","target_column":"%s","confidence_score":%se-2,"match_type":"exact","transformation_rule":"f(%s)","reasoning":"r %s"}',
            first, kind, brand, word, size, key, key))
        .when(shape == 1, text(
            '{"source_columns":["q.%s"],"target":"%s.%s","confidence":%se-2,"match_type":"Exact","transformation":"g(%s)","reason":null}',
            kind, brand, word, size, key))
        .when(shape == 2, F.lit('{"target_column":null,"target":"x","source_columns":[1]}'))
        .when(shape == 3, text('{"target_column":"%s","source_column":"s.one","match_type":"manual"}', word))
        .when(shape == 4, text(
            '{"target_table":"%s","target_column":"%s","source_columns":["q.%s","q.%s"],"confidence_score":%se-2,"transformation_rule":null,"match_type":null}',
            brand, word, kind, kind, size))
        .otherwise(F.lit('{"target_column":"","source_columns":[]}'))
    )


def _grouped(spark, sf):
    part = table(spark, sf, "part")
    gid = F.floor(F.col("p_partkey") / ITEMS_PER_REPLY).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", _item_text().alias("text"))))
    items = F.array_join(F.transform(ordered, lambda o: o["text"]), ",\n")
    return part.groupBy(gid.alias("g")).agg(items.alias("items"))


def reply_texts(spark, sf):
    """One reply per eight parts, in eight forms: fenced, repairable, aliased, blank, broken, without JSON, ill-typed, plain."""
    form, items = F.col("g") % 8, F.col("items")
    given = F.when(F.col("g") % 3 == 0, ',"global_confidence":0.75').otherwise("")
    tail = F.concat(F.lit('"unmapped_source_columns":["a.b",null,""],"analysis_summary":"s'), F.col("g").cast("string"), F.lit('"'), given)
    plain = F.concat(F.lit('{"mappings":['), items, F.lit("],"), tail, F.lit("}"))
    text = (
        F.when(form == 0, F.concat(F.lit("Here you go:\n```json\n"), plain, F.lit("\n```\nbye {x}")))
        .when(form == 1, F.concat(F.lit('Sure! {"unmapped_target_columns":["t.u", ],"mappings":['), items, F.lit("],"), tail, F.lit(",\n } done")))
        .when(form == 2, F.concat(F.lit('{"mapping":['), items, F.lit("],"), tail, F.lit("}")))
        .when(form == 3, F.lit(" \n\t"))
        .when(form == 4, F.concat(F.lit('{"mappings":['), items, F.lit('],"unmapped_target_columns":["t.u",]}')))
        .when(form == 5, F.lit("I cannot map these files."))
        .when(form == 6, F.concat(F.lit('{"mappings":['), items, F.lit(',{"target_column":"T","source_columns":["x",1]}],'), tail, F.lit("}")))
        .otherwise(F.concat(F.lit("result: "), plain, F.lit(" trailing words")))
    )
    return _grouped(spark, sf).select(F.col("g").cast("string").alias("request_id"), text.alias("reply_text"))


def envelope_texts(spark, sf):
    """Refine replies: wrapped or bare, with a message, a null message, or none."""
    form = F.col("g") % 4
    inner = F.concat(F.lit('{"mappings":['), F.col("items"), F.lit("]}"))
    text = (
        F.when(form == 0, F.concat(F.lit('{"mapping":'), inner, F.lit(',"message":"done "}')))
        .when(form == 1, F.concat(F.lit('{"mapping":'), inner, F.lit(',"message":null}')))
        .when(form == 2, inner)
        .otherwise(F.concat(F.lit('{"mapping":'), inner, F.lit(',"message":7}')))
    )
    return _grouped(spark, sf).select(F.col("g").cast("string").alias("request_id"), text.alias("reply_text"))


def _expected(aliases: bool = False) -> str:
    single = "['s.one']" if aliases else "[]"
    return f"""
p AS (SELECT *, p_partkey // {ITEMS_PER_REPLY} AS g, p_partkey % 6 AS v, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part),
items AS (SELECT g, p_partkey AS k,
    CASE v WHEN 3 THEN w2 ELSE p_brand || '.' || w2 END AS target_column,
    CASE v WHEN 0 THEN [w1 || '.' || p_type, 'x.y'] WHEN 1 THEN ['q.' || p_type] WHEN 3 THEN {single} ELSE ['q.' || p_type, 'q.' || p_type] END AS sources,
    CASE v WHEN 3 THEN 0.0 ELSE p_size / 100.0 END AS conf, CASE v WHEN 0 THEN 'exact' ELSE 'semantic' END AS mt,
    CASE v WHEN 0 THEN 'r ' || p_partkey ELSE '' END AS reasoning,
    CASE v WHEN 0 THEN 'f(' || p_partkey || ')' WHEN 1 THEN 'g(' || p_partkey || ')' END AS rule
  FROM p WHERE v NOT IN (2, 5)),
src AS (SELECT g, target_column, s, min((k, ix)) AS first_at FROM (SELECT g, target_column, k, unnest(sources) AS s, generate_subscripts(sources, 1) AS ix FROM items) GROUP BY ALL),
lists AS (SELECT g, target_column, string_agg(s, '|' ORDER BY first_at) AS l FROM src GROUP BY ALL),
merged AS (SELECT g, target_column, CASE WHEN count(*) = 1 THEN array_to_string(any_value(sources), '|') ELSE coalesce(any_value(l), '') END AS source_columns,
    max(conf) AS confidence_score, arg_max(mt, k) AS match_type, arg_max(reasoning, k) AS reasoning,
    arg_max(rule, k) FILTER (WHERE rule IS NOT NULL) AS transformation_rule, min(k) AS first_k
  FROM items LEFT JOIN lists USING (g, target_column) GROUP BY g, target_column)"""


ITEM_SELECT = """SELECT CAST(g AS VARCHAR) AS request_id, target_column, source_columns, confidence_score, match_type, reasoning, transformation_rule,
  CAST(row_number() OVER (PARTITION BY g ORDER BY first_k) - 1 AS BIGINT) AS pos FROM merged"""


def _items(normalized):
    return replies.reply_items(normalized).withColumn("source_columns", F.array_join("source_columns", "|"))


def n1_n16_reply_items(spark, sf):
    return _items(replies.normalize_replies(reply_texts(spark, sf)))


N_ITEMS = f"WITH {_expected()} {ITEM_SELECT} WHERE g % 8 NOT IN (3, 4, 5, 6)"


def n9_single_source_aliases(spark, sf):
    return _items(replies.normalize_replies(reply_texts(spark, sf), aliases=True))


N9 = f"WITH {_expected(aliases=True)} {ITEM_SELECT} WHERE g % 8 NOT IN (3, 4, 5, 6)"


def n14_n15_reply_results(spark, sf):
    r = replies.reply_results(replies.normalize_replies(reply_texts(spark, sf))).filter(F.col("error").isNull())
    return r.select(
        "request_id", F.array_join("unmapped_source_columns", "|").alias("unmapped_source"), F.array_join("unmapped_target_columns", "|").alias("unmapped_target"),
        F.round("global_confidence", 9).alias("global_confidence"), "analysis_summary",
    )


N14 = f"""WITH {_expected()}, m AS (SELECT g, avg(confidence_score) AS mean FROM merged GROUP BY g), gs AS (SELECT DISTINCT g FROM p)
SELECT CAST(g AS VARCHAR) AS request_id, 'a.b' AS unmapped_source, CASE WHEN g % 8 = 1 THEN 't.u' ELSE '' END AS unmapped_target,
  round(CASE WHEN g % 3 = 0 THEN 0.75 ELSE coalesce(mean, 0.0) END, 9) AS global_confidence, 's' || g AS analysis_summary
FROM gs LEFT JOIN m USING (g) WHERE g % 8 NOT IN (3, 4, 5, 6)"""


def n1_n2_n3_reply_errors(spark, sf):
    return replies.reply_errors(replies.normalize_replies(reply_texts(spark, sf)))


N_ERRORS = f"""SELECT CAST(g AS VARCHAR) AS request_id,
  CASE g % 8 WHEN 3 THEN 'empty reply' WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'no JSON in reply' ELSE 'unexpected kind of value' END AS error
FROM (SELECT DISTINCT p_partkey // {ITEMS_PER_REPLY} AS g FROM part) WHERE g % 8 IN (3, 4, 5, 6)"""


def n5_refine_envelope(spark, sf):
    normalized = replies.normalize_replies(envelope_texts(spark, sf), envelope=True)
    return normalized.select("request_id", F.coalesce(F.size("mappings"), F.lit(0)).cast("bigint").alias("n_items"), "message", "error")


N5 = f"""WITH {_expected()}, n AS (SELECT g, count(*) AS n FROM merged GROUP BY g), gs AS (SELECT DISTINCT g FROM p)
SELECT CAST(g AS VARCHAR) AS request_id, CASE WHEN g % 4 = 3 THEN 0 ELSE coalesce(n, 0) END AS n_items,
  CASE g % 4 WHEN 0 THEN 'done ' WHEN 3 THEN NULL ELSE 'Mapping updated.' END AS message, CASE WHEN g % 4 = 3 THEN 'unexpected kind of value' END AS error
FROM gs LEFT JOIN n USING (g)"""


def s4_n2_reply_scan(spark, sf):
    """JSON text found in each reply, by length and digest: fenced, between words, bare, or not there."""
    part = table(spark, sf, "part")
    json = F.concat(F.lit('{"k":'), F.col("p_partkey").cast("string"), F.lit(',"n":["'), F.col("p_name"), F.lit('",{"t":"}'), F.col("p_type"), F.lit('"}]}')).alias("json")
    form = F.col("p_partkey") % 4
    text = F.when(form == 0, F.concat(F.lit("Here:\n```json\n"), json, F.lit("\n```\nbye"))).when(form == 1, F.concat(F.lit("so "), json, F.lit(" done"))).when(form == 2, json).otherwise(F.lit("none"))
    found = part.select(F.col("p_partkey").cast("string").alias("request_id"), replies.extract_json(text).alias("json_text"))
    return found.select("request_id", F.char_length("json_text").cast("bigint").alias("n_chars"), F.md5("json_text").alias("digest"))


S4 = """WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN p_partkey % 4 < 3 THEN '{"k":' || p_partkey || ',"n":["' || p_name || '",{"t":"}' || p_type || '"}]}' END AS t FROM part)
SELECT request_id, length(t) AS n_chars, md5(t) AS digest FROM f"""

QUERIES = {
    "s4_n2_reply_scan": (s4_n2_reply_scan, S4),
    "n1_n2_n3_n16_reply_errors": (n1_n2_n3_reply_errors, N_ERRORS),
    "n4_n12_reply_items": (n1_n16_reply_items, N_ITEMS),
    "n5_refine_envelope": (n5_refine_envelope, N5),
    "n9_single_source_aliases": (n9_single_source_aliases, N9),
    "n14_n15_reply_results": (n14_n15_reply_results, N14),
}
