"""Queries over budgeted reduction, tier choice and prompt assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.operators import budget, reduction
from colweave.schemas import REDUCTION_LEVELS, REDUCTION_LIMITS, SYSTEM_PROMPT_TOKENS
from workloads.corpus import WS
from workloads.standins import FILES_PER_REQUEST, RAW_FILES_SQL, REQUESTS_SQL, raw_files, requests, table

TOKEN_LIMIT = 8_000
LINES = f"list_filter(string_split(content, chr(10)), lambda l: trim(l, {WS}) <> '')"
FIXED = SYSTEM_PROMPT_TOKENS + 4200


def reduced_sql(level: str) -> str:
    rows, _, text = REDUCTION_LIMITS[level]
    return f"""CASE WHEN NOT ends_with(file_name, '.md') THEN
      CASE WHEN len({LINES}) <= {rows} THEN content
           ELSE array_to_string(({LINES})[1:{rows}], chr(10)) || chr(10) || '... (' || (len({LINES}) - {rows}) || ' more data rows, ' || len({LINES}) || ' total)' END
      ELSE CASE WHEN len(string_split(content, chr(10))) <= {text} THEN content
           ELSE array_to_string(string_split(content, chr(10))[1:{text}], chr(10)) || chr(10) || '... (truncated from ' || len(string_split(content, chr(10))) || ' lines)' END END"""


def _digest(files):
    return files.select("file_name", F.char_length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


def _digest_sql(content: str, source: str = "raw_files") -> str:
    return f"SELECT file_name, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM (SELECT file_name, {content} AS c FROM {source})"


def _all_levels(files):
    """Every file at every level, from one scan: levels are an array exploded beside the file."""
    staged = reduction.stage_files(files)
    variants = F.array(*[F.struct(F.lit(lv).alias("level"), reduction.reduced_content(lv).alias("reduced")) for lv in REDUCTION_LEVELS])
    rows = staged.select("file_name", F.inline(variants))
    return rows.select("file_name", "level", F.char_length("reduced").cast("bigint").alias("n_chars"), F.md5("reduced").alias("digest"))


def c3_c4_reduce_all_levels(spark, sf):
    return _all_levels(raw_files(spark, sf))


C3_C4 = f"WITH {RAW_FILES_SQL} " + " UNION ALL ".join(
    f"SELECT file_name, '{lv}' AS level, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM (SELECT file_name, {reduced_sql(lv)} AS c FROM raw_files)"
    for lv in REDUCTION_LEVELS
)


def c5_delimited_head(spark, sf):
    return _digest(reduction.reduce_files(raw_files(spark, sf), "heavy").filter(~F.col("file_name").endswith(".md")))


C5 = f"WITH {RAW_FILES_SQL} {_digest_sql(reduced_sql('heavy'))} WHERE NOT ends_with(file_name, '.md')"


def c10_text_head(spark, sf):
    return _digest(reduction.reduce_files(raw_files(spark, sf), "heavy").filter(F.col("file_name").endswith(".md")))


C10 = f"WITH {RAW_FILES_SQL} {_digest_sql(reduced_sql('heavy'))} WHERE ends_with(file_name, '.md')"

DICT_ROWS = 8


def _dictionaries(spark, sf):
    """Data dictionaries of eight rows: long descriptions, and a short row that lacks its last cells."""
    part = table(spark, sf, "part")
    gid = F.floor(F.col("p_partkey") / DICT_ROWS).cast("bigint")
    cells = F.concat_ws(
        ";", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")),
        F.when(F.col("p_partkey") % 7 != 0, F.lower("p_type")),
        F.when(F.col("p_partkey") % 7 != 0, F.repeat(F.concat("p_type", F.lit(" ")), (F.col("p_size") / 5).cast("int"))),
    )
    rows = part.groupBy(gid.alias("pos")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("line")))).alias("rows"))
    text = F.concat(
        F.lit("Table ; column_name;Data Type;description\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    )
    return rows.select(
        F.lit("0").alias("request_id"), F.lit("source").alias("side"), "pos",
        F.concat(F.lit("dict_"), F.col("pos").cast("string"), F.lit(".csv")).alias("file_name"), text.alias("content"),
    )


_PARTS = f"(SELECT *, p_partkey // {DICT_ROWS} AS g, replace(p_name, ' ', '_') AS col, repeat(p_type || ' ', p_size // 5) AS descr FROM part)"


def _dict_sql(row: str, head: str, tail: str) -> str:
    return f"""WITH files AS (SELECT 'dict_' || g || '.csv' AS file_name,
  {head} || chr(10) || string_agg({row}, chr(10) ORDER BY p_partkey) || {tail} AS c, count(*) AS n FROM {_PARTS} GROUP BY g)
SELECT file_name, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM files"""


FULL_ROW = "CASE WHEN p_partkey % 7 = 0 THEN p_brand || ';' || col ELSE p_brand || ';' || col || ';' || lower(p_type) || ';' || descr END"
CUT_ROW = FULL_ROW.replace("|| descr", "|| CASE WHEN length(descr) > 50 THEN left(descr, 50) || '...' ELSE descr END")
KEPT_ROW = "p_brand || ';' || col || ';' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_type) END"


def c6_dictionary_light(spark, sf):
    return _digest(reduction.reduce_files(_dictionaries(spark, sf), "light"))


C6 = _dict_sql(FULL_ROW, "'Table ; column_name;Data Type;description' || chr(10)", "''")


def c7_dictionary_heavy(spark, sf):
    return _digest(reduction.reduce_files(_dictionaries(spark, sf), "heavy"))


C7 = _dict_sql(KEPT_ROW, "'Table;column_name;Data Type'", "chr(10) || '(compressed: kept 3 of 4 columns)'")


def c8_dictionary_medium(spark, sf):
    return _digest(reduction.reduce_files(_dictionaries(spark, sf), "medium"))


C8 = _dict_sql(CUT_ROW, "'Table ; column_name;Data Type;description'", "''")


def _json_arrays(spark, sf):
    """JSON arrays as people write them: numbers of several spellings, nested values, brackets in strings, inner space."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    number = F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).when(key % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("e3"))).otherwise("-0")
    row = F.concat(
        F.lit('{"zz_size" : '), number, F.lit(',  "name":"'), "p_name", F.lit(' ], \\" } [", "more":[1,\t{"x":[2, "a,b"]} ]\n}')
    )
    item = F.when(key % 7 == 0, F.concat(F.lit('"only, ['), "p_name", F.lit('"'))).when(key % 7 == 1, number).when(key % 7 == 2, "null").otherwise(row)
    files = part.groupBy(F.floor(key / 5).cast("bigint").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("items"))
    text = F.concat(F.lit(" [ "), F.array_join(F.transform("items", lambda r: r["item"]), " ,\n"), F.lit("\t]\n"))
    name = F.concat(F.lit("parts_"), F.col("pos").cast("string"), F.lit(".json"))
    return files.select(F.lit("0").alias("request_id"), F.lit("source").alias("side"), "pos", name.alias("file_name"), text.alias("content"))


def c9_json_array_head(spark, sf):
    return _all_levels(_json_arrays(spark, sf))


def _json_sql(level: str) -> str:
    keep = REDUCTION_LIMITS[level][1]
    full = "' [ ' || array_to_string(objs, ' ,' || chr(10)) || chr(9) || ']' || chr(10)"
    cut = f"'[' || chr(10) || array_to_string(objs[1:{keep}], ',' || chr(10)) || chr(10) || ']' || chr(10) || '// ... (' || (len(objs) - {keep}) || ' more objects, ' || len(objs) || ' total)'"
    return f"SELECT file_name, '{level}' AS level, CASE WHEN len(objs) > {keep} THEN {cut} ELSE {full} END AS c FROM files"


JSON_FILES = """items AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN p_size || '.50' WHEN 1 THEN p_size || 'e3' ELSE '-0' END AS num FROM part),
files AS (SELECT 'parts_' || (p_partkey // 5) || '.json' AS file_name,
  list(CASE p_partkey % 7 WHEN 0 THEN '"only, [' || p_name || '"' WHEN 1 THEN num WHEN 2 THEN 'null'
    ELSE '{"zz_size" : ' || num || ',  "name":"' || p_name || ' ], \\" } [", "more":[1,' || chr(9) || '{"x":[2, "a,b"]} ]' || chr(10) || '}' END ORDER BY p_partkey) AS objs
  FROM items GROUP BY p_partkey // 5)"""
C9 = f"""WITH {JSON_FILES},
r AS ({" UNION ALL ".join(_json_sql(lv) for lv in REDUCTION_LEVELS)})
SELECT file_name, level, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM r"""


def c11_lengths(spark, sf):
    """Lengths of JSON arrays and dictionaries at every level, by arithmetic."""
    files = _json_arrays(spark, sf).unionByName(_dictionaries(spark, sf))
    return reduction.file_lengths(files).select("file_name", "len_raw", *[f"len_{lv}" for lv in REDUCTION_LEVELS])


C11_LENGTHS = f"""WITH {JSON_FILES},
j AS ({" UNION ALL ".join(_json_sql(lv) for lv in REDUCTION_LEVELS)}),
raw AS (SELECT file_name, length(' [ ' || array_to_string(objs, ' ,' || chr(10)) || chr(9) || ']' || chr(10)) AS n FROM files),
d AS (SELECT 'dict_' || g || '.csv' AS file_name, count(*) AS n, sum(length({FULL_ROW})) AS f, sum(length({CUT_ROW})) AS m, sum(length({KEPT_ROW})) AS h FROM {_PARTS} GROUP BY g),
w AS (SELECT *, length('Table ; column_name;Data Type;description') AS title FROM d)
SELECT raw.file_name, CAST(raw.n AS BIGINT) AS len_raw, {", ".join(f"CAST(max(length(c)) FILTER (level = '{lv}') AS BIGINT) AS len_{lv}" for lv in REDUCTION_LEVELS)}
FROM raw JOIN j USING (file_name) GROUP BY ALL
UNION ALL SELECT file_name, CAST(title + 2 + f + n - 1 AS BIGINT), CAST(title + 2 + f + n - 1 AS BIGINT), CAST(CASE WHEN n + 1 <= {REDUCTION_LIMITS["medium"][0]} THEN title + 2 + f + n - 1 ELSE title + m + n END AS BIGINT),
  CAST(CASE WHEN n + 1 <= {REDUCTION_LIMITS["heavy"][0]} THEN title + 2 + f + n - 1 ELSE length('Table;column_name;Data Type') + h + n + length('(compressed: kept 3 of 4 columns)') + 1 END AS BIGINT) FROM w"""


# --- budget ------------------------------------------------------------------------------------------------------

ESTIMATES_SQL = f"""{RAW_FILES_SQL}, {REQUESTS_SQL},
sizes AS (
  SELECT request_id, side, length(file_name) AS name_len, length(content) AS len_raw,
         {", ".join(f"length({reduced_sql(lv)}) AS len_{lv}" for lv in REDUCTION_LEVELS)}, strlen(content) AS bytes
  FROM raw_files),
totals AS (
  SELECT request_id, count(*) FILTER (WHERE side = 'source') AS n_source, count(*) FILTER (WHERE side = 'target') AS n_target,
         {", ".join(f"sum(ceil(len_{t} / 4.0) + ceil(name_len / 4.0) + 20) AS f_{t}" for t in ("raw", *REDUCTION_LEVELS))}
  FROM sizes GROUP BY request_id),
estimates AS (
  SELECT r.request_id, r.user_instruction, r.rules, n_source, n_target,
         {", ".join(f"CAST(f_{t} + {FIXED} + CASE WHEN trim(coalesce(user_instruction, ''), {WS}) = '' THEN 0 ELSE ceil(length(user_instruction) / 4.0) END + CASE WHEN trim(coalesce(rules, ''), {WS}) = '' THEN 0 ELSE ceil(length(rules) / 4.0) END AS BIGINT) AS tokens_{t}" for t in ("raw", *REDUCTION_LEVELS))}
  FROM requests r JOIN totals USING (request_id)),
plan AS (
  SELECT *, CASE WHEN tokens_raw <= {TOKEN_LIMIT} THEN 'raw' WHEN tokens_light <= {TOKEN_LIMIT} THEN 'light'
                 WHEN tokens_medium <= {TOKEN_LIMIT} THEN 'medium' ELSE 'heavy' END AS tier FROM estimates)"""


def c2_request_estimate(spark, sf):
    return budget.estimate_requests(raw_files(spark, sf), requests(spark, sf)).select("request_id", "tokens_raw")


C2 = f"WITH {ESTIMATES_SQL} SELECT request_id, tokens_raw FROM estimates"


def _plan(spark, sf):
    return budget.plan_requests(raw_files(spark, sf), requests(spark, sf), TOKEN_LIMIT)


def c11_tier_choice(spark, sf):
    tokens = [f"tokens_{t}" for t in ("raw", *REDUCTION_LEVELS)]
    return _plan(spark, sf).select("request_id", *tokens, "tier", "tier_label")


C11 = f"""WITH {ESTIMATES_SQL} SELECT request_id, tokens_raw, tokens_light, tokens_medium, tokens_heavy, tier,
  CASE tier WHEN 'raw' THEN 'Tier 1 (raw)' WHEN 'light' THEN 'Tier 2 (light)' WHEN 'medium' THEN 'Tier 3 (medium)' ELSE 'Tier 4 (heavy)' END AS tier_label
FROM plan"""


def c12_prompt_text(spark, sf):
    prompts = budget.build_prompts(raw_files(spark, sf), _plan(spark, sf))
    return prompts.select("request_id", F.char_length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


def _blocks(side: str, content: str) -> str:
    return f"coalesce(string_agg(chr(10) || '--- File: ' || file_name || ' ---' || chr(10) || {content} || chr(10), '' ORDER BY pos) FILTER (WHERE side = '{side}'), '')"


C12 = f"""WITH {ESTIMATES_SQL},
chosen AS (SELECT f.request_id, side, pos, file_name, CASE tier WHEN 'raw' THEN content
    {" ".join(f"WHEN '{lv}' THEN {reduced_sql(lv)}" for lv in REDUCTION_LEVELS)} END AS c
  FROM raw_files f JOIN plan p USING (request_id)),
blocks AS (SELECT request_id, {_blocks("source", "c")} AS src, {_blocks("target", "c")} AS tgt FROM chosen GROUP BY request_id),
prompts AS (SELECT request_id,
  '{budget.PROMPT_HEAD}'
  || CASE WHEN trim(coalesce(user_instruction, ''), {WS}) = '' THEN '' ELSE chr(10) || chr(10) || 'User''s instruction: ' || trim(user_instruction, {WS}) END
  || CASE WHEN trim(coalesce(rules, ''), {WS}) = '' THEN '' ELSE chr(10) || chr(10) || 'ADDITIONAL RULES (you MUST follow these):' || chr(10) || trim(rules, {WS}) END
  || chr(10) || chr(10) || '=== SOURCE FILES ===' || chr(10) || src
  || chr(10) || '=== TARGET FILES ===' || chr(10) || tgt AS prompt
  FROM plan JOIN blocks USING (request_id) WHERE n_source > 0 AND n_target > 0)
SELECT request_id, CAST(length(prompt) AS BIGINT) AS n_chars, md5(prompt) AS digest FROM prompts"""


def c13_refine_context(spark, sf):
    item = F.struct(
        F.concat(F.lit("t."), F.col("request_id")).alias("target_column"), F.array(F.lit("s.a")).alias("source_columns"),
        F.lit(0.5).alias("confidence_score"), F.lit("semantic").alias("match_type"),
        F.lit(None).cast("string").alias("reasoning"), F.lit("trim(a)").alias("transformation_rule"),
    )
    mapping = F.struct(
        F.array(item).alias("mappings"), F.array(F.lit("s.b")).alias("unmapped_source_columns"),
        F.array().cast("array<string>").alias("unmapped_target_columns"), F.lit(0.5).alias("global_confidence"), F.lit("ok").alias("analysis_summary"),
    )
    message = F.struct(F.when(F.col("request_id").cast("int") % 2 == 0, "assistant").otherwise("system").alias("role"), F.lit("hello").alias("content"))
    refinements = requests(spark, sf).select(
        "request_id", "rules", mapping.alias("current_mapping"), F.array(message).alias("messages"), F.lit(" rename it ").alias("user_message")
    )
    out = budget.refine_contexts(raw_files(spark, sf), refinements, "refine")
    one = F.posexplode("messages").alias("turn", "m")
    rows = out.select("request_id", one)
    return rows.select("request_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.md5("m.content").alias("digest"))


_NL = "' || chr(10) || '"
_PRETTY = _NL.join(
    [
        "'{", '  "Mappings" : [ {', '    "TargetColumn" : "t.\' || request_id || \'",', '    "SourceColumns" : [ "s.a" ],',
        '    "ConfidenceScore" : 0.5,', '    "MatchType" : "semantic",', '    "Reasoning" : null,', '    "TransformationRule" : "trim(a)"',
        "  } ],", '  "UnmappedSourceColumns" : [ "s.b" ],', '  "UnmappedTargetColumns" : [ ],', '  "GlobalConfidence" : 0.5,',
        '  "AnalysisSummary" : "ok"', "}'",
    ]
)
C13 = f"""WITH {RAW_FILES_SQL}, {REQUESTS_SQL},
blocks AS (SELECT request_id, {_blocks("source", "content")} AS src, {_blocks("target", "content")} AS tgt FROM raw_files GROUP BY request_id
  HAVING count(*) FILTER (WHERE side = 'source') > 0 AND count(*) FILTER (WHERE side = 'target') > 0),
ctx AS (SELECT request_id, 'refine' || chr(10) || chr(10) || chr(10) || '=== SOURCE FILES ===' || chr(10) || src
  || chr(10) || '=== TARGET FILES ===' || chr(10) || tgt || chr(10) || 'CURRENT_MAPPING:' || chr(10) || {_PRETTY} || chr(10)
  || CASE WHEN trim(coalesce(rules, ''), {WS}) = '' THEN '' ELSE chr(10) || 'ADDITIONAL RULES (you MUST follow these):' || chr(10) || trim(rules, {WS}) || chr(10) END AS c
  FROM blocks JOIN requests USING (request_id)),
m AS (SELECT request_id, 0 AS turn, 'system' AS role, c FROM ctx UNION ALL
      SELECT request_id, 1, CASE WHEN CAST(request_id AS INT) % 2 = 0 THEN 'assistant' ELSE 'user' END, 'hello' FROM ctx UNION ALL
      SELECT request_id, 2, 'user', 'rename it' FROM ctx)
SELECT request_id, CAST(turn AS BIGINT) AS turn, role, md5(c) AS digest FROM m"""


def c14_rules_text(spark, sf):
    """All turns of one conversation as its rules; a conversation is short."""
    turns = table(spark, sf, "conversations")
    rules = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("contents"))
    return rules.select("conv_id", F.md5(budget.rules_text(F.col("contents"))).alias("digest"))


C14 = """SELECT conv_id, md5(nullif(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), ''), '')) AS digest
FROM conversations GROUP BY conv_id"""


def c15_required_inputs(spark, sf):
    """Sides by language, so that some requests have no file on one side and are refused."""
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "lang")
    side = F.when(F.col("lang").isin("en", "fr"), "source").otherwise("target")
    files = raw_files(spark, sf).join(langs, "pos").withColumn("side", side).drop("lang")
    plan = budget.plan_requests(files, requests(spark, sf))
    return plan.select("request_id", "n_source", "n_target", "reject_reason")


C15 = f"""WITH n AS (SELECT CAST(doc_id // {FILES_PER_REQUEST} AS VARCHAR) AS request_id,
    count(*) FILTER (WHERE lang IN ('en', 'fr')) AS n_source, count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) AS n_target
  FROM documents GROUP BY 1)
SELECT request_id, n_source, n_target,
  CASE WHEN n_source = 0 OR n_target = 0 THEN 'a request needs files of both sides' END AS reject_reason FROM n"""

QUERIES = {
    "c2_request_estimate": (c2_request_estimate, C2),
    "c3_c4_reduce_all_levels": (c3_c4_reduce_all_levels, C3_C4),
    "c5_delimited_head": (c5_delimited_head, C5),
    "c6_dictionary_light": (c6_dictionary_light, C6),
    "c7_dictionary_heavy": (c7_dictionary_heavy, C7),
    "c8_dictionary_medium": (c8_dictionary_medium, C8),
    "c9_json_array_head": (c9_json_array_head, C9),
    "c10_text_head": (c10_text_head, C10),
    "c11_tier_choice": (c11_tier_choice, C11),
    "c11_lengths": (c11_lengths, C11_LENGTHS),
    "c12_prompt_text": (c12_prompt_text, C12),
    "c13_refine_context": (c13_refine_context, C13),
    "c14_rules_text": (c14_rules_text, C14),
    "c15_required_inputs": (c15_required_inputs, C15),
}
