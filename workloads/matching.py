"""Queries over column matching, checked by comparing all pairs in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.operators import matching
from workloads.standins import table

PARTS_PER_REQUEST = 100


def catalog(spark, sf):
    """Part names as source columns, and rearranged ones as target columns; a hundred parts to a request."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    w1, w2 = words[0], F.element_at(words, 2)
    types = F.element_at(F.array(*[F.lit(t) for t in ("varchar", "int", "date")]), (F.col("p_size") % 3 + 1).cast("int"))
    target_type = F.element_at(F.array(*[F.lit(t) for t in ("string", "bigint", "datetime")]), (key % 3 + 1).cast("int"))
    source_name = F.when(key % 5 == 0, w1).when(key % 5 == 1, w2).otherwise(F.concat_ws("_", w1, w2))
    target_name = (
        F.when(key % 4 == 0, F.concat(w2, F.initcap(w1))).when(key % 4 == 1, F.concat_ws(" ", w1, w2, F.lit("code")))
        .when(key % 4 == 2, F.concat_ws("_", w1, w2)).otherwise(F.concat(F.lit("misc"), key.cast("string")))
    )
    columns = ["request_id", "side", "table_name", "column_name", "data_type"]
    request = F.floor(key / PARTS_PER_REQUEST).cast("string")
    source = part.select(request, F.lit("source"), F.concat(F.lit("s"), F.floor(key / 20).cast("string")), source_name, types).toDF(*columns)
    target = part.select(request, F.lit("target"), F.concat(F.lit("t"), F.floor(key / 20).cast("string")), target_name, target_type).toDF(*columns)
    return _first_type(source.unionByName(target))


def _first_type(columns):
    """One row per column: a name that occurs with several types keeps the least."""
    return columns.groupBy("request_id", "side", "table_name", "column_name").agg(F.min("data_type").alias("data_type"))


_CATALOG = f"""
p AS (SELECT *, p_partkey // {PARTS_PER_REQUEST} AS r, p_partkey // 20 AS t, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part),
source AS (SELECT r, 's' || t AS tbl, CASE p_partkey % 5 WHEN 0 THEN w1 WHEN 1 THEN w2 ELSE w1 || '_' || w2 END AS col,
    min((['varchar', 'int', 'date'])[p_size % 3 + 1]) AS ty FROM p GROUP BY ALL),
target AS (SELECT r, 't' || t AS tbl, CASE p_partkey % 4 WHEN 0 THEN w2 || upper(left(w1, 1)) || substring(w1, 2) WHEN 1 THEN w1 || ' ' || w2 || ' code'
    WHEN 2 THEN w1 || '_' || w2 ELSE 'misc' || p_partkey END AS col, min((['string', 'bigint', 'datetime'])[p_partkey % 3 + 1]) AS ty FROM p GROUP BY ALL),
fam(ty, family) AS (VALUES ('varchar', 'text'), ('string', 'text'), ('int', 'integer'), ('bigint', 'integer'), ('date', 'date'), ('datetime', 'timestamp')),
s AS (SELECT r, tbl, tbl || '.' || col AS q, string_split(col, '_') AS tok, ty, family FROM source JOIN fam USING (ty)),
t AS (SELECT r, tbl, tbl || '.' || col AS q, string_split(regexp_replace(replace(lower(regexp_replace(col, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), ' ', '_'), '_+', '_'), '_') AS tok, ty, family
      FROM target JOIN fam USING (ty)),"""


def _runs(tok):
    return (
        f"list_distinct(flatten(list_transform(range(1, len({tok}) + 1), lambda i: "
        f"list_transform(range(i, len({tok}) + 1), lambda j: array_to_string({tok}[i:j], ' ')))))"
    )


# All pairs of a request, scored by the three ways names can be alike.
PAIRS = f"""
sx AS (SELECT *, {_runs("tok")} AS runs, list_distinct(tok) AS words, array_to_string(tok, '') AS spelling FROM s),
tx AS (SELECT *, {_runs("tok")} AS runs, list_distinct(tok) AS words, array_to_string(tok, '') AS spelling FROM t),
compared AS (SELECT t.r, t.q AS tq, s.q AS sq, t.tbl AS tt, s.tbl AS st, s.tok AS s_tok, t.tok AS t_tok, t.ty AS t_ty, s.family = t.family AS same_type,
    len(s.tok) AS ns, len(t.tok) AS nt, len(s.words) AS ds, len(t.words) AS dt, len(list_intersect(s.words, t.words)) AS shared,
    coalesce(list_max(list_transform(list_intersect(s.runs, t.runs), lambda x: len(string_split(x, ' ')))), 0) AS k,
    levenshtein(s.spelling, t.spelling) AS d, greatest(length(s.spelling), length(t.spelling)) AS longer
  FROM tx t JOIN sx s ON s.r = t.r),
named AS (SELECT *, greatest(k / CAST(ns + nt - k AS DOUBLE),
    CASE WHEN shared > 0 AND ds - shared <= 1 AND dt - shared <= 1 THEN CAST(0.95 AS DOUBLE) * (shared / CAST(ds + dt - shared AS DOUBLE)) ELSE 0 END,
    CASE WHEN d <= 1 AND 1 - d / CAST(longer AS DOUBLE) >= 0.75 THEN CAST(0.9 AS DOUBLE) * (1 - d / CAST(longer AS DOUBLE)) ELSE 0 END) AS name_score FROM compared),
scored AS (SELECT *, CAST(0.8 AS DOUBLE) * name_score + CASE WHEN same_type THEN CAST(0.2 AS DOUBLE) ELSE 0 END AS score FROM named WHERE name_score > 0),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY r, tq ORDER BY round(score, 12) DESC, sq) = 1)"""
CATALOG_SQL = f"{_CATALOG.rstrip().rstrip(',')}, {PAIRS}"


def spelled_catalog(spark, sf):
    """Part names as source columns; as targets the same with other endings, lost or swapped letters, and other orders."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    w1, w2 = words[0], F.element_at(words, 2)
    kind = F.lower(F.split("p_type", " ")[0])
    source_name = (
        F.when(key % 4 == 0, F.concat(w1, F.lit("s"))).when(key % 4 == 1, F.concat_ws("_", F.lit("id"), w1, kind))
        .when(key % 4 == 2, F.concat_ws("_", kind, w1, w2)).otherwise(F.concat_ws("_", w1, w2))
    )
    target_name = (
        F.when(key % 6 == 0, w1)
        .when(key % 6 == 1, F.concat(F.left(w1, F.lit(2)), F.substring(w1, 4, 99)))
        .when(key % 6 == 2, F.concat_ws("_", w1, kind, F.lit("id")))
        .when(key % 6 == 3, F.concat_ws(" ", w2, w1, kind))
        .when(key % 6 == 4, F.concat(w1, F.lit("x"), w2))
        .otherwise(F.concat_ws("_", w2, F.lit("the"), w1))
    )
    columns = ["request_id", "side", "table_name", "column_name", "data_type"]
    request = F.floor(key / PARTS_PER_REQUEST).cast("string")
    source = part.select(request, F.lit("source"), F.concat(F.lit("s"), F.floor(key / 20).cast("string")), source_name, F.lit("varchar")).toDF(*columns)
    target = part.select(request, F.lit("target"), F.concat(F.lit("t"), F.floor(key / 20).cast("string")), target_name, F.lit("string")).toDF(*columns)
    return _first_type(source.unionByName(target))


def m2_spelling_and_order(spark, sf):
    """Names that differ in spelling or in the order of their words."""
    return _best(spelled_catalog(spark, sf))


M2 = f"""WITH p AS (SELECT *, p_partkey // {PARTS_PER_REQUEST} AS r, p_partkey // 20 AS t, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2,
    lower(string_split(p_type, ' ')[1]) AS kind FROM part),
s AS (SELECT DISTINCT r, 's' || t AS tbl, col, 's' || t || '.' || col AS q, string_split(col, '_') AS tok, 'varchar' AS ty, 'text' AS family FROM (
    SELECT r, t, CASE p_partkey % 4 WHEN 0 THEN w1 || 's' WHEN 1 THEN 'id_' || w1 || '_' || kind WHEN 2 THEN kind || '_' || w1 || '_' || w2 ELSE w1 || '_' || w2 END AS col FROM p)),
t AS (SELECT DISTINCT r, 't' || t AS tbl, col, 't' || t || '.' || col AS q, string_split(replace(col, ' ', '_'), '_') AS tok, 'string' AS ty, 'text' AS family FROM (
    SELECT r, t, CASE p_partkey % 6 WHEN 0 THEN w1 WHEN 1 THEN left(w1, 2) || substring(w1, 4) WHEN 2 THEN w1 || '_' || kind || '_id' WHEN 3 THEN w2 || ' ' || w1 || ' ' || kind
      WHEN 4 THEN w1 || 'x' || w2 ELSE w2 || '_the_' || w1 END AS col FROM p)), {PAIRS}
SELECT CAST(r AS VARCHAR) AS request_id, tq AS target_column, sq AS source_column, round(score, 9) AS score FROM best"""


def m1_m3_best_match(spark, sf):
    return _best(catalog(spark, sf))


def _best(c):
    best = matching.best_matches(matching.named_columns(c))
    return best.select("request_id", F.col("qualified").alias("target_column"), F.col("source.qualified").alias("source_column"), F.round("score", 9).alias("score"))


M1_M3 = f"WITH {CATALOG_SQL} SELECT CAST(r AS VARCHAR) AS request_id, tq AS target_column, sq AS source_column, round(score, 9) AS score FROM best"

ALIGNED = """
votes AS (SELECT r, tt, st, count(*) AS n FROM best GROUP BY ALL),
aligned AS (SELECT r, tt, st FROM votes QUALIFY row_number() OVER (PARTITION BY r, tt ORDER BY n DESC, st) = 1),
words AS (SELECT DISTINCT s.r, s.tbl, array_to_string(tok, ' ') AS w, q FROM s),
whole AS (SELECT t.r, t.q, a.st, t.tok, len(t.tok) AS n FROM t JOIN aligned a ON a.r = t.r AND a.tt = t.tbl WHERE len(t.tok) > 1),
spans AS (SELECT w.*, x.f, x.l, array_to_string(tok[x.f:x.l], ' ') AS run FROM whole w, (SELECT a.range AS f, b.range AS l FROM range(1, 4) a, range(1, 4) b WHERE a.range <= b.range) x WHERE x.l <= n AND x.l - x.f + 1 < n),
hits AS (SELECT sp.r, sp.q, sp.n, f, l, ww.q AS src FROM spans sp JOIN words ww ON ww.r = sp.r AND ww.tbl = sp.st AND ww.w = sp.run),
widest AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.r = h.r AND g.q = h.q AND g.f <= h.f AND g.l >= h.l AND g.l - g.f > h.l - h.f)),
cover AS (SELECT r, q, n, p.range AS pos, bool_or(f <= p.range AND l >= p.range) AS ok FROM widest, range(1, 4) p WHERE p.range <= n GROUP BY ALL),
whole_ok AS (SELECT r, q FROM cover GROUP BY r, q HAVING bool_and(ok)),
derived AS (SELECT r, q, list(src ORDER BY f, l) AS srcs FROM widest JOIN whole_ok USING (r, q) GROUP BY r, q HAVING count(DISTINCT src) > 1)"""


def m4_m6_match_columns(spark, sf):
    items = matching.match_columns(catalog(spark, sf))
    return items.select("request_id", "target_column", F.array_join("source_columns", "|").alias("source_columns"), F.round("confidence_score", 9).alias("confidence_score"), "match_type", "transformation_rule")


ITEMS_SQL = f"""{CATALOG_SQL}, {ALIGNED},
items AS (SELECT t.r, t.q AS target_column,
    CASE WHEN d.srcs IS NOT NULL AND coalesce(b.s_tok <> t.tok, true) THEN d.srcs WHEN b.sq IS NOT NULL THEN [b.sq] ELSE [] END AS sources, coalesce(score, 0) AS confidence_score,
    CASE WHEN d.srcs IS NOT NULL AND coalesce(b.s_tok <> t.tok, true) THEN 'derived' WHEN b.sq IS NULL THEN 'incompatible' WHEN NOT same_type THEN 'transformed'
         WHEN b.s_tok = t.tok THEN 'exact' ELSE 'semantic' END AS match_type, b.sq, t.ty
  FROM t LEFT JOIN best b ON b.r = t.r AND b.tq = t.q LEFT JOIN derived d ON d.r = t.r AND d.q = t.q)"""
M4_M6 = f"""WITH {ITEMS_SQL} SELECT CAST(r AS VARCHAR) AS request_id, target_column, array_to_string(sources, '|') AS source_columns, round(confidence_score, 9) AS confidence_score, match_type,
  CASE match_type WHEN 'derived' THEN 'CONCAT_WS('' '', ' || array_to_string(sources, ', ') || ')'
    WHEN 'transformed' THEN 'CAST(' || sq || ' AS ' || CASE ty WHEN 'datetime' THEN 'TIMESTAMP' ELSE upper(ty) END || ')' END AS transformation_rule FROM items"""


def m7_unknown_references(spark, sf):
    """Items checked against a catalogue that lacks the date and time columns, so that references go missing."""
    c = catalog(spark, sf)
    items = matching.match_columns(c)
    return matching.unknown_references(items, c.filter(~F.col("data_type").isin("date", "datetime")))


M7 = f"""WITH {ITEMS_SQL}, refs AS (SELECT r, 'source' AS side, unnest(sources) AS qualified FROM items UNION SELECT r, 'target', target_column FROM items),
dated AS (SELECT r, 'source' AS side, q AS qualified FROM s WHERE ty = 'date' UNION ALL SELECT r, 'target', q FROM t WHERE ty = 'datetime')
SELECT CAST(r AS VARCHAR) AS request_id, side, qualified FROM refs JOIN dated USING (r, side, qualified)"""


def m8_coverage(spark, sf):
    c = catalog(spark, sf)
    return matching.coverage(matching.match_columns(c), c)


M8 = f"""WITH {ITEMS_SQL}, used AS (SELECT DISTINCT r, unnest(sources) AS q FROM items)
SELECT CAST(s.r AS VARCHAR) AS request_id, 'source' AS side, s.q AS qualified FROM s LEFT JOIN used u ON u.r = s.r AND u.q = s.q WHERE u.q IS NULL
UNION ALL SELECT CAST(r AS VARCHAR), 'target', target_column FROM items WHERE len(sources) = 0"""

QUERIES = {
    "m1_m3_best_match": (m1_m3_best_match, M1_M3),
    "m2_spelling_and_order": (m2_spelling_and_order, M2),
    "m4_m6_match_columns": (m4_m6_match_columns, M4_M6),
    "m7_unknown_references": (m7_unknown_references, M7),
    "m8_coverage": (m8_coverage, M8),
}
