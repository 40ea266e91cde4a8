"""Queries over raw files: scans, statistics, column catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colweave.functions.delimited import first_line, looks_like_dictionary, presence_delimiter, vote_delimiter
from colweave.functions.text import base_name, estimate_tokens, file_extension
from colweave.operators import catalog
from colweave.session import shared_folder
from colweave.sources import files
from workloads.standins import RAW_FILES_SQL, raw_files, table

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LINES = f"list_filter(string_split(trim(content, {WS}), chr(10)), lambda l: trim(l, {WS}) <> '')"
FIRST = f"string_split(trim(content, {WS}), chr(10))[1]"


def _count(piece: str) -> str:
    return f"(length(line) - length(replace(line, {piece}, '')))"


VOTE = f"""CASE WHEN {_count("','")} = m THEN ',' WHEN {_count("chr(9)")} = m THEN chr(9)
            WHEN {_count("';'")} = m THEN ';' ELSE '|' END"""
VOTED_SQL = f"""
firsts AS (SELECT *, {FIRST} AS line FROM raw_files),
voted AS (SELECT *, {VOTE} AS delimiter
          FROM (SELECT *, greatest({_count("','")}, {_count("chr(9)")}, {_count("';'")}, {_count("'|'")}) AS m FROM firsts))"""


def cells_sql(line: str, delimiter: str = "delimiter") -> str:
    """Quote-toggling cells of a line as a list."""
    return f"""list_transform(string_split(array_to_string(list_transform(string_split({line}, '"'),
        lambda s, i: CASE WHEN i % 2 = 1 THEN replace(s, {delimiter}, '"') ELSE s END), ''), '"'),
        lambda c: trim(c, {WS}))"""


PARTS_PER_FILE = 5

# --- scans -------------------------------------------------------------------------------------------------------


def s1_raw_file_scan(spark, sf):
    """Whole text of every file with its name and side; the table holds what a scan of a folder of files returns."""
    f = raw_files(spark, sf)
    return f.select("request_id", "side", "file_name", F.char_length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


S1 = f"""WITH {RAW_FILES_SQL}
SELECT request_id, side, file_name, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM raw_files"""


def _written_files(spark, sf):
    """Part names as lines of text files: a folder for every hundred parts. Tasks write many folders each, with files of
    one name in all of them."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    part = table(spark, sf, "part")
    part.select(F.col("p_name").alias("value"), F.floor(F.col("p_partkey") / 100).alias("folder")).repartition("folder").write.partitionBy("folder").text(path)
    return path + "/*"


def _folder():
    return F.regexp_extract("file_path", r"folder=(\d+)", 1).alias("folder")


def s1_whole_files(spark, sf):
    """Files of one name in several folders, each as one text."""
    found = files.scan_raw_files(spark, _written_files(spark, sf), "source")
    return found.select(_folder(), F.col("file_name").isNotNull().alias("named"), F.char_length("content").cast("bigint").alias("n_chars"))


S1_WHOLE = "SELECT CAST(p_partkey // 100 AS VARCHAR) AS folder, true AS named, CAST(sum(length(p_name) + 1) AS BIGINT) AS n_chars FROM part GROUP BY 1"


def s1_file_lines(spark, sf):
    """The same files line by line, and their first three lines."""
    lines = files.scan_file_lines(spark, _written_files(spark, sf), "source")
    heads = files.head_lines(lines, 3).groupBy(_folder()).agg(F.count("*").alias("n_head"))
    each = lines.groupBy(_folder()).agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).cast("bigint").alias("n_chars"))
    return each.join(heads, "folder")


S1_LINES = """SELECT CAST(p_partkey // 100 AS VARCHAR) AS folder, count(*) AS n_lines, CAST(sum(length(p_name)) AS BIGINT) AS n_chars, CAST(least(3, count(*)) AS BIGINT) AS n_head FROM part GROUP BY 1"""


def s5_delimited_scan(spark, sf):
    rows = files.scan_delimited(raw_files(spark, sf))
    return rows.select("file_name", F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "¦").alias("cells"))


S5 = f"""WITH {RAW_FILES_SQL}, {VOTED_SQL},
lines AS (SELECT file_name, delimiter, unnest(list_zip(range(1000000)[1:len({LINES})], {LINES})) AS z FROM voted)
SELECT file_name, CAST(z[1] AS BIGINT) AS row_no, array_to_string({cells_sql("z[2]")}, '¦') AS cells FROM lines"""


def s6_quoted_cells(spark, sf):
    """Quoted cells over page markup, whose attributes are full of quotes, commas and semicolons."""
    from colweave.functions.delimited import split_quoted

    line = F.explode(F.split("html", "\n")).alias("line")
    lines = table(spark, sf, "pages").select("page_id", line)
    cells = split_quoted(F.col("line"), F.lit(";"))
    return lines.groupBy("page_id").agg(
        F.sum(F.size(cells)).cast("bigint").alias("n_cells"),
        F.sum(F.char_length(F.array_join(cells, ""))).cast("bigint").alias("n_chars"),
    )


S6 = f"""WITH lines AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages),
c AS (SELECT page_id, {cells_sql("line", "';'")} AS cells FROM lines)
SELECT page_id, CAST(sum(len(cells)) AS BIGINT) AS n_cells,
       CAST(sum(length(array_to_string(cells, ''))) AS BIGINT) AS n_chars FROM c GROUP BY page_id"""


def _json_files(spark, sf):
    """Customers as JSON documents, one file each, with nested objects and arrays."""
    doc = F.to_json(
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"),
            F.array("c_custkey", "c_nationkey").alias("keys"),
        )
    )
    return table(spark, sf, "customer").select(
        F.lit("0").alias("request_id"), F.lit("source").alias("side"),
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("file_name"),
        F.col("c_custkey").alias("pos"), doc.alias("content"),
    )


def s7_json_profile(spark, sf):
    nodes = files.profile_json(_json_files(spark, sf))
    return nodes.select("file_name", "path", F.col("depth").cast("bigint").alias("depth"), "kind", F.col("n_children").cast("bigint").alias("n_children"))


S7 = """WITH shape(path, depth, kind, n_children) AS (VALUES
  ('$', 0, 'object', 3), ('$.home', 1, 'object', 2), ('$.home.nation', 2, 'number', 0), ('$.home.segment', 2, 'string', 0),
  ('$.keys', 1, 'array', 2), ('$.keys[0]', 2, 'number', 0), ('$.keys[1]', 2, 'number', 0), ('$.name', 1, 'string', 0))
SELECT 'customer_' || c_custkey || '.json' AS file_name, path, CAST(depth AS BIGINT) AS depth, kind,
       CAST(n_children AS BIGINT) AS n_children FROM customer CROSS JOIN shape"""


def s7_varied_profile(spark, sf):
    """Arrays of values of all kinds, one for each part of a file."""
    part = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    tags = F.to_json(F.split("p_name", " "))
    value = (
        F.when(key % 5 == 0, size).when(key % 5 == 1, F.concat(F.lit('"'), "p_type", F.lit('"'))).when(key % 5 == 2, "null")
        .when(key % 5 == 3, F.concat(F.lit('{"size": '), size, F.lit(', "tags": '), tags, F.lit("}")))
        .otherwise(F.element_at(F.array(F.lit("[]"), F.lit("{}"), F.lit("true")), (F.col("p_size") % 3 + 1).cast("int")))
    )
    files_of = part.groupBy(F.floor(key / PARTS_PER_FILE).cast("bigint").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", value.alias("v")))).alias("vs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("vs", lambda x: x["v"]), ", "), F.lit("]"))
    made = files_of.select(F.lit("0").alias("request_id"), F.lit("source").alias("side"), "pos", F.concat(F.lit("v_"), F.col("pos").cast("string"), F.lit(".json")).alias("file_name"), text.alias("content"))
    nodes = files.profile_json(made)
    return nodes.select("file_name", "path", F.col("depth").cast("bigint").alias("depth"), "kind", F.col("n_children").cast("bigint").alias("n_children"))


S7_VARIED = f"""WITH p AS (SELECT *, p_partkey // {PARTS_PER_FILE} AS g, '$[' || (row_number() OVER (PARTITION BY p_partkey // {PARTS_PER_FILE} ORDER BY p_partkey) - 1) || ']' AS place,
  string_split(p_name, ' ') AS tags FROM part),
n AS (SELECT g, '$' AS path, 0 AS depth, 'array' AS kind, count(*) AS n_children FROM p GROUP BY g
  UNION ALL SELECT g, place, 1, CASE p_partkey % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'null' WHEN 3 THEN 'object' ELSE (['array', 'object', 'boolean'])[p_size % 3 + 1] END,
    CASE WHEN p_partkey % 5 = 3 THEN 2 ELSE 0 END FROM p
  UNION ALL SELECT g, place || '.size', 2, 'number', 0 FROM p WHERE p_partkey % 5 = 3
  UNION ALL SELECT g, place || '.tags', 2, 'array', len(tags) FROM p WHERE p_partkey % 5 = 3
  UNION ALL SELECT g, place || '.tags[' || unnest(range(len(tags))) || ']', 3, 'string', 0 FROM p WHERE p_partkey % 5 = 3)
SELECT 'v_' || g || '.json' AS file_name, path, CAST(depth AS BIGINT) AS depth, kind, CAST(n_children AS BIGINT) AS n_children FROM n"""


# --- file facts --------------------------------------------------------------------------------------------------


def a1_a2_file_names(spark, sf):
    name = F.col("file_name")
    return raw_files(spark, sf).select("file_name", file_extension(name).alias("ext"), base_name(name).alias("base"))


A1_A2 = f"""WITH {RAW_FILES_SQL}
SELECT file_name, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS ext,
       regexp_replace(file_name, '\\.[^.]+$', '') AS base FROM raw_files"""


def a3_delimiter_vote(spark, sf):
    return raw_files(spark, sf).select("file_name", vote_delimiter(first_line(F.col("content"))).alias("delimiter"))


A3 = f"WITH {RAW_FILES_SQL}, {VOTED_SQL} SELECT file_name, delimiter FROM voted"


def a4_delimiter_presence(spark, sf):
    return raw_files(spark, sf).select("file_name", presence_delimiter(F.split("content", "\n", 2)[0]).alias("delimiter"))


A4 = f"""WITH {RAW_FILES_SQL}, f AS (SELECT file_name, string_split(content, chr(10))[1] AS line FROM raw_files)
SELECT file_name, CASE WHEN contains(line, chr(9)) THEN chr(9) WHEN contains(line, ';') THEN ';' ELSE ',' END AS delimiter FROM f"""


def a5_dictionary_test(spark, sf):
    """Applied to the lines of page markup, where words such as table and type occur."""
    line = F.explode(F.split("html", ">")).alias("line")
    lines = table(spark, sf, "pages").select("page_id", line)
    return lines.groupBy("page_id").agg(F.count_if(looks_like_dictionary(F.col("line"))).alias("n_dictionary_lines"))


KEYWORDS = "['table', 'column', 'field', 'type', 'schema', 'description', 'comment', 'nullable']"
A5 = f"""WITH lines AS (SELECT page_id, unnest(string_split(html, '>')) AS line FROM pages)
SELECT page_id, count(*) FILTER (WHERE len(list_filter({KEYWORDS}, lambda k: contains(lower(line), k))) >= 2) AS n_dictionary_lines
FROM lines GROUP BY page_id"""



def _part_files(spark, sf, content, ext):
    """Parts grouped into files of five; groups are bounded by construction."""
    part = table(spark, sf, "part")
    gid = F.floor(F.col("p_partkey") / PARTS_PER_FILE).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
    grouped = part.groupBy(gid.alias("pos")).agg(ordered.alias("parts"))
    return grouped.select(
        F.lit("0").alias("request_id"), F.lit("source").alias("side"), "pos",
        F.concat(F.lit("parts_"), F.col("pos").cast("string"), F.lit("." + ext)).alias("file_name"),
        content.alias("content"),
    )


def _catalog_rows(columns):
    return columns.select(
        "file_name", "table_name", "column_name", F.col("ordinal").cast("bigint").alias("ordinal"), "data_type", "nullable"
    )


def schema_documents(spark, sf):
    """JSON schema documents: one column per part, table name on every other file."""
    columns = F.transform(
        "parts",
        lambda p: F.struct(
            F.replace(p["p_name"], F.lit(" "), F.lit("_")).alias("name"),
            F.lower(p["p_type"]).alias("data_type"),
            (p["p_size"] > 25).alias("nullable"),
        ),
    )
    table_name = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("t"), F.col("pos").cast("string")))
    return _part_files(spark, sf, F.to_json(F.struct(table_name.alias("table_name"), columns.alias("columns"))), "json")


def a6_json_schema_columns(spark, sf):
    return _catalog_rows(catalog.list_columns(schema_documents(spark, sf)))


A6 = f"""SELECT 'parts_' || g || '.json' AS file_name, CASE WHEN g % 2 = 0 THEN 't' || g ELSE 'parts_' || g END AS table_name,
  replace(p_name, ' ', '_') AS column_name, CAST(row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS BIGINT) AS ordinal,
  lower(p_type) AS data_type, p_size > 25 AS nullable
FROM (SELECT *, p_partkey // {PARTS_PER_FILE} AS g FROM part)"""


def a7_json_array_columns(spark, sf):
    """Arrays of objects: only the keys of the first object count, in document order."""
    rows = F.transform(
        "parts",
        lambda p: F.struct(p["p_size"].alias("zz_size"), p["p_name"].alias("name"), F.when(p["p_size"] > 25, p["p_brand"]).alias("brand")),
    )
    return _catalog_rows(catalog.list_columns(_part_files(spark, sf, F.to_json(rows), "json")))


A7 = f"""WITH firsts AS (SELECT p_partkey // {PARTS_PER_FILE} AS g, arg_min(p_size, p_partkey) AS size FROM part GROUP BY 1),
k AS (SELECT g, unnest(CASE WHEN size > 25 THEN [(1, 'zz_size'), (2, 'name'), (3, 'brand')]
                             ELSE [(1, 'zz_size'), (2, 'name')] END) AS k FROM firsts)
SELECT 'parts_' || g || '.json' AS file_name, 'parts_' || g AS table_name, k[2] AS column_name, CAST(k[1] AS BIGINT) AS ordinal,
       CAST(NULL AS VARCHAR) AS data_type, CAST(NULL AS BOOLEAN) AS nullable FROM k"""


def a8_json_without_columns(spark, sf):
    """Event payloads are valid JSON objects without columns: files that list nothing, counted against all."""
    ev = table(spark, sf, "events").select(
        F.lit("0").alias("request_id"), F.lit("source").alias("side"), F.col("event_id").alias("pos"),
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(","))).otherwise(F.col("props")).alias("content"),
    )
    listed = catalog.list_columns(ev).groupBy("file_name").agg(F.count("*").alias("n_columns"))
    return ev.select("file_name").join(listed, "file_name", "left").select("file_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


A8 = """SELECT 'e' || event_id || '.json' AS file_name, CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_columns FROM events"""


def a9_header_columns(spark, sf):
    return _catalog_rows(catalog.list_columns(raw_files(spark, sf))).drop("data_type", "nullable")


A9 = f"""WITH {RAW_FILES_SQL},
h AS (SELECT file_name, list_filter(list_transform(regexp_split_to_array({FIRST}, '[,;\t|]'), lambda x: trim(x, {WS})), lambda x: x <> '') AS names
      FROM raw_files),
z AS (SELECT file_name, unnest(list_zip(range(1, 1000000)[1:len(names)], names)) AS z FROM h)
SELECT file_name, regexp_replace(file_name, '\\.[^.]+$', '') AS table_name, z[2] AS column_name, CAST(z[1] AS BIGINT) AS ordinal FROM z"""


def dictionary_files(spark, sf):
    """Data dictionaries: a header and one described column per part."""
    rows = F.transform(
        "parts",
        lambda p: F.concat_ws(
            ",", p["p_brand"], F.replace(p["p_name"], F.lit(" "), F.lit("_")), F.lower(p["p_type"]),
            F.when(p["p_size"] > 25, "true").otherwise("false"), F.repeat(F.concat(p["p_type"], F.lit(" ")), p["p_size"] / 4),
        ),
    )
    text = F.concat(F.lit("table_name,column_name,data_type,nullable,description\n"), F.array_join(rows, "\n"))
    return _part_files(spark, sf, text, "csv")


def a10_dictionary_columns(spark, sf):
    return _catalog_rows(catalog.list_dictionary_columns(dictionary_files(spark, sf)))


A10 = f"""SELECT 'parts_' || g || '.csv' AS file_name, p_brand AS table_name, replace(p_name, ' ', '_') AS column_name,
  CAST(row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS BIGINT) AS ordinal, lower(p_type) AS data_type, p_size > 25 AS nullable
FROM (SELECT *, p_partkey // {PARTS_PER_FILE} AS g FROM part)"""


def a11_text_schema_columns(spark, sf):
    lines = F.transform(
        "parts",
        lambda p: F.format_string("%s (decimal(%d,2), was %s)", F.replace(p["p_name"], F.lit(" "), F.lit("_")), p["p_size"], p["p_type"]),
    )
    text = F.concat(F.format_string("=== PARTS (p%d) ===\n", F.col("pos")), F.array_join(lines, "\n"))
    return _catalog_rows(catalog.list_text_columns(_part_files(spark, sf, text, "txt"))).drop("nullable")


A11 = f"""SELECT 'parts_' || g || '.txt' AS file_name, 'p' || g AS table_name, replace(p_name, ' ', '_') AS column_name,
  CAST(row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS BIGINT) AS ordinal, 'decimal(' || p_size || ',2)' AS data_type
FROM (SELECT *, p_partkey // {PARTS_PER_FILE} AS g FROM part)"""


def a12_catalog_search(spark, sf):
    found = catalog.search_columns(catalog.list_columns(schema_documents(spark, sf)), " _Wi ")
    return found.select("file_name", "qualified", F.col("ordinal").cast("bigint").alias("ordinal"))


A12 = f"""SELECT file_name, table_name || '.' || column_name AS qualified, ordinal FROM ({A6})
WHERE contains(lower(table_name || '.' || column_name), '_wi')"""


def _searches(spark, sf):
    """Pieces of part names of several lengths, some of them in upper case or blank, as searches of many users."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    piece = F.substring("p_name", (key % 4 + 1).cast("int"), (key % 6).cast("int"))
    return part.filter("p_partkey % 10 < 9").select(key.alias("search_id"), F.when(key % 2 == 0, F.upper(piece)).otherwise(F.concat(F.lit(" "), piece)).alias("query"))


def a12_bulk_search(spark, sf):
    """All searches against the catalogue at once: how many columns each finds, and the first of them.

    Each text is searched once and its answer given to all who search it. A column has few pieces, so what the texts find
    grows with the columns, while what the searches find grows with both.
    """
    searches = _searches(spark, sf).select("search_id", catalog.search_text(F.col("query")).alias("wanted"))
    texts = searches.select("wanted").distinct()
    found = catalog.search_columns_for(catalog.list_columns(schema_documents(spark, sf)), texts.select(F.col("wanted").alias("search_id"), F.col("wanted").alias("query")))
    answers = found.groupBy(F.col("search_id").alias("wanted")).agg(F.count("*").alias("n_found"), F.min("qualified").alias("first_found"))
    return searches.hint("merge").join(answers, "wanted").groupBy("search_id").agg(F.sum("n_found").alias("n_found"), F.min("first_found").alias("first_found"))


A12_BULK = f"""WITH names AS (SELECT table_name || '.' || column_name AS qualified, count(*) AS n FROM ({A6}) GROUP BY 1),
q AS (SELECT p_partkey AS search_id, lower(trim(substring(p_name, p_partkey % 4 + 1, p_partkey % 6))) AS wanted FROM part WHERE p_partkey % 10 < 9)
SELECT search_id, CAST(sum(n) AS BIGINT) AS n_found, min(qualified) AS first_found FROM q JOIN names ON contains(lower(qualified), wanted) GROUP BY 1"""


def a13_file_statistics(spark, sf):
    stats = files.file_statistics(raw_files(spark, sf))
    return stats.select("file_name", F.col("n_columns").cast("bigint").alias("n_columns"), F.col("n_rows").cast("bigint").alias("n_rows"))


A13 = f"""WITH {RAW_FILES_SQL}, {VOTED_SQL}
SELECT file_name, CAST(len({cells_sql(f"({LINES})[1]")}) AS BIGINT) AS n_columns, CAST(len({LINES}) - 1 AS BIGINT) AS n_rows FROM voted"""


def a14_numbered_preview(spark, sf):
    rows = files.preview_rows(raw_files(spark, sf))
    return rows.select(
        "file_name", F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "¦").alias("cells"), F.col("n_more").cast("bigint").alias("n_more")
    )


A14 = f"""WITH s AS ({S5}), n AS (SELECT file_name, max(row_no) AS n_rows FROM s GROUP BY 1)
SELECT s.file_name, s.row_no, s.cells, greatest(n.n_rows - 50, 0) AS n_more FROM s JOIN n USING (file_name)
WHERE s.row_no BETWEEN 1 AND 50"""


def c1_token_estimate(spark, sf):
    return raw_files(spark, sf).select("file_name", estimate_tokens(F.col("content")).alias("tokens"))


C1 = f"WITH {RAW_FILES_SQL} SELECT file_name, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM raw_files"

QUERIES = {
    "s1_whole_files": (s1_whole_files, S1_WHOLE),
    "s1_file_lines": (s1_file_lines, S1_LINES),
    "s1_raw_file_scan": (s1_raw_file_scan, S1),
    "s5_delimited_scan": (s5_delimited_scan, S5),
    "s6_quoted_cells": (s6_quoted_cells, S6),
    "s7_json_profile": (s7_json_profile, S7),
    "s7_varied_profile": (s7_varied_profile, S7_VARIED),
    "a1_a2_file_names": (a1_a2_file_names, A1_A2),
    "a3_delimiter_vote": (a3_delimiter_vote, A3),
    "a4_delimiter_presence": (a4_delimiter_presence, A4),
    "a5_dictionary_test": (a5_dictionary_test, A5),
    "a6_json_schema_columns": (a6_json_schema_columns, A6),
    "a7_json_array_columns": (a7_json_array_columns, A7),
    "a8_json_without_columns": (a8_json_without_columns, A8),
    "a9_header_columns": (a9_header_columns, A9),
    "a10_dictionary_columns": (a10_dictionary_columns, A10),
    "a11_text_schema_columns": (a11_text_schema_columns, A11),
    "a12_catalog_search": (a12_catalog_search, A12),
    "a12_bulk_search": (a12_bulk_search, A12_BULK),
    "a13_file_statistics": (a13_file_statistics, A13),
    "a14_numbered_preview": (a14_numbered_preview, A14),
    "c1_token_estimate": (c1_token_estimate, C1),
}
