"""Queries over the mapping table: merge, reports, edits, exports, and the flagship application of a mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.confidence import column_part, confidence_band, confidence_percent, table_part
from colweave.operators import apply, catalog, edits, mapping, matching
from colweave.sources import exports
from workloads.standins import ITEM_REQUESTS, MAPPING_ITEMS_SQL, mapping_items, table

# --- flagship: the example orders mapping ----------------------------------------------------------------------

ORDER_RULES = [
    apply.Rule("order_id", "CAST(o_orderkey AS VARCHAR)", "string"),
    apply.Rule("customer_ref", "CAST(o_custkey AS STRING)", "string"),
    apply.Rule("order_date", "CAST(o_orderdate AS DATE)", "date"),
    apply.Rule("amount", "`o_totalprice`", "double", source="o_totalprice"),
    apply.Rule("status", "CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'SHIPPED' ELSE 'CANCELLED' END", "string"),
]


def order_items(spark):
    """The same rules as a mapping table, as a reply would deliver them."""
    rows = [
        ("0", f"orders_new.{r.target}", [f"orders.{r.source or 'o_' + r.target}"], 0.9, "transformed", "example", None if r.source else r.expression, i)
        for i, r in enumerate(ORDER_RULES)
    ]
    rows[3][2][0] = "o_totalprice"
    rows.append(("0", "orders_new.ghost", [], 0.0, "", None, None, 9))
    rows.append(("0", "orders_new.void", ["orders.x"], 0.1, "incompatible", None, None, 10))
    schema = "request_id string, target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string, pos bigint"
    return spark.createDataFrame(rows, schema)


ORDER_TYPES = {r.target: r.data_type for r in ORDER_RULES}


def flagship(spark, sf_dir):
    """Rules read from the mapping table, applied to all orders."""
    rules = apply.rules_for(order_items(spark), "orders_new", ORDER_TYPES)
    return apply.project_mapping(table(spark, sf_dir, "orders"), rules)


def _as_text(df, *columns):
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns])


def x1_x6_project_mapping(spark, sf):
    return _as_text(flagship(spark, sf), "order_date")


X1 = """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_ref,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_totalprice AS amount,
  CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'SHIPPED' ELSE 'CANCELLED' END AS status FROM orders"""


def x2_chain_mapping(spark, sf):
    """A later rule sees the result of an earlier one; untouched columns stay."""
    rules = [
        apply.Rule("c_acctbal", "c_acctbal * 2"),
        apply.Rule("balance_band", "CASE WHEN c_acctbal > 10000 THEN 'high' ELSE 'low' END"),
        apply.Rule("customer_name", "`c_name`", source="customer.c_name"),
    ]
    return apply.chain_mapping(table(spark, sf, "customer"), rules)


X2 = """SELECT c_custkey, c_name AS customer_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment,
  CASE WHEN c_acctbal * 2 > 10000 THEN 'high' ELSE 'low' END AS balance_band FROM customer"""


def x3_multi_source_mapping(spark, sf):
    """One target table from two source tables; qualified names resolve through the table aliases."""
    tables = {"lineitem": table(spark, sf, "lineitem"), "part": table(spark, sf, "part")}
    joined = apply.join_sources(tables, ["lineitem.l_partkey = part.p_partkey"], "lineitem")
    rules = [
        apply.Rule("order_id", "lineitem.l_orderkey"), apply.Rule("line_no", "lineitem.l_linenumber"),
        apply.Rule("item", "CONCAT(part.p_brand, ' / ', part.p_name)"), apply.Rule("net", "lineitem.l_extendedprice * (1 - lineitem.l_discount)"),
    ]
    return apply.project_mapping(joined, rules)


X3 = """SELECT l_orderkey AS order_id, l_linenumber AS line_no, p_brand || ' / ' || p_name AS item,
  l_extendedprice * (1 - l_discount) AS net FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""


def x4_rule_language(spark, sf):
    """Every scalar keyword family of the rule language, in the spelling rules are written in."""
    rules = [
        apply.Rule("k", "CONVERT(VARCHAR, p_partkey)"),
        apply.Rule("a", "CONCAT(UPPER(TRIM(p_name)), '-', LOWER(SUBSTRING(p_brand, 1, 5)))"),
        apply.Rule("b", "CASE WHEN p_size BETWEEN 10 AND 20 OR p_type IN ('ECONOMY', 'PROMO') THEN 'x' WHEN p_name LIKE 'red%' AND NOT p_size IS NULL THEN 'y' ELSE REPLACE(p_type, 'A', 'VARCHAR') END"),
        apply.Rule("c", "COALESCE(NULL, CAST(p_size AS BIGINT)) + CAST('2' AS INTEGER)"),
        apply.Rule("d", "CAST(CONVERT(DECIMAL(12,2), p_retailprice) AS DOUBLE)"),
        apply.Rule("e", "CAST(p_size > 25 AS BOOLEAN) = TRUE"),
        apply.Rule("f", "CAST(CAST('2024-01-02' AS DATETIME) AS VARCHAR)"),
    ]
    for r in rules:
        apply.check_rule(r.expression)
    return apply.project_mapping(table(spark, sf, "part"), [apply.Rule(r.target, apply.to_spark_sql(r.expression)) for r in rules])


X4 = """SELECT CAST(p_partkey AS VARCHAR) AS k, upper(trim(p_name)) || '-' || lower(substring(p_brand, 1, 5)) AS a,
  CASE WHEN p_size BETWEEN 10 AND 20 OR p_type IN ('ECONOMY', 'PROMO') THEN 'x' WHEN p_name LIKE 'red%' AND p_size IS NOT NULL THEN 'y'
       ELSE replace(p_type, 'A', 'VARCHAR') END AS b,
  CAST(p_size AS BIGINT) + 2 AS c, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) AS d, p_size > 25 AS e, '2024-01-02 00:00:00' AS f FROM part"""


def x4_aggregate_rules(spark, sf):
    """Aggregates in rules are allowed under explicit group keys."""
    rules = [
        apply.Rule("flag", "l_returnflag"), apply.Rule("status", "l_linestatus"), apply.Rule("n", "COUNT(*)"),
        apply.Rule("quantity", "SUM(l_quantity)"), apply.Rule("largest", "MAX(l_quantity)"), apply.Rule("smallest", "MIN(l_quantity)"),
        apply.Rule("mean", "ROUND(AVG(l_quantity), 6)"), apply.Rule("orders", "COUNT(DISTINCT l_orderkey)"),
    ]
    return apply.aggregate_mapping(table(spark, sf, "lineitem"), rules, ["l_returnflag", "l_linestatus"])


X4_AGG = """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS quantity, max(l_quantity) AS largest,
  min(l_quantity) AS smallest, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL"""


def x_files_to_rows(spark, sf):
    """From files to rows: a header and a free-text schema become a catalogue, its columns are matched, the mapping is
    applied to the table that the header describes."""
    orders = table(spark, sf, "orders")
    wanted = "=== Orders (orders_new) ===\norderkey (bigint)\norder_status (varchar)\ntotalprice (double, not null)\norderdate (date)\no_custkey (varchar)\nshipping (text)"
    rows = [("0", "source", "orders.csv", ",".join(orders.columns)), ("0", "target", "orders_new.txt", wanted)]
    described = catalog.described_columns(spark.createDataFrame(rows, "request_id string, side string, file_name string, content string"))
    items = matching.match_columns(described)
    types = {r["column_name"]: r["data_type"] for r in described.filter("side = 'target'").collect()}
    return _as_text(apply.project_mapping(orders.alias("orders"), apply.rules_for(items, "orders_new", types)), "orderdate")


X_FILES = """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS orderdate, CAST(o_orderkey AS BIGINT) AS orderkey, o_orderstatus AS order_status,
  CAST(o_totalprice AS DOUBLE) AS totalprice FROM orders"""


# Rules that are queries: columns of the parts table filled from its lines and suppliers.
QUERY_RULES = (
    apply.QueryRule(
        "sold",
        "SELECT p.p_partkey, SUM(l.l_quantity) FROM lineitem AS l INNER JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_discount BETWEEN 0.01 AND 0.09 "
        "GROUP BY p.p_partkey HAVING COUNT(*) > 2",
        ("p_partkey",),
    ),
    apply.QueryRule(
        "last_flag",
        "SELECT p.p_partkey, MAX(CASE WHEN l.l_returnflag IS NULL THEN 'none' ELSE LOWER(l.l_returnflag) END) FROM lineitem l RIGHT JOIN part p "
        "ON l.l_partkey = p.p_partkey AND NOT l.l_linestatus = 'F' GROUP BY p.p_partkey",
        ("p_partkey",),
    ),
    apply.QueryRule(
        "size_class",
        "SELECT p_partkey, 'small' FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, CONCAT('size ', CONVERT(VARCHAR, p_size)) FROM part WHERE p_size >= 10 AND p_size IN (10, 20, 30)",
        ("p_partkey",),
    ),
    apply.QueryRule(
        "lines",
        "SELECT p.p_partkey, COALESCE(COUNT(DISTINCT l.l_orderkey), 0) FROM part p LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem UNION SELECT l_orderkey, l_partkey FROM lineitem) l "
        "ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey",
        ("p_partkey",),
    ),
)
# Query rules that are refused, and why.
REFUSED_QUERIES = {
    "SELECT p_partkey, p_name FROM part ORDER BY p_name": "no order",
    "SELECT p_partkey, p_name FROM part LIMIT 5": "rows would be lost",
    "SELECT p_partkey, p_name FROM part OFFSET 5": "rows would be lost",
    "SELECT p.p_partkey, l_quantity FROM part p, lineitem": "needs a condition",
    "SELECT p_partkey, explode(split(p_name, ' ')) FROM part": "generators",
    "SELECT p_partkey, `rand`() FROM part": "differs between runs",
    "SELECT p_partkey, current_date() FROM part": "differs between runs",
    "SELECT p_partkey, row_number() OVER (ORDER BY p_name) FROM part": "windows",
    "SELECT p_partkey, (SELECT MAX(l_quantity) FROM lineitem) FROM part": "cannot hold a query",
    "SELECT id, id FROM range(5)": "only the registered tables",
}


def x4_query_rules(spark, sf):
    """Rules with joins, groups and unions fill columns of every part; what may not be a rule is refused on the same tables."""
    tables = {"part": table(spark, sf, "part"), "lineitem": table(spark, sf, "lineitem")}
    for query, reason in REFUSED_QUERIES.items():
        try:
            apply.checked_query(spark, tables, query)
        except apply.MappingError as e:
            if reason not in str(e):
                raise
        else:
            raise AssertionError(f"accepted: {query}")
    rows = tables["part"].select("p_partkey")
    return apply.query_mapping(rows, tables, list(QUERY_RULES))


X4_QUERIES = """SELECT p_partkey,
  (SELECT CASE WHEN count(*) > 2 THEN sum(l_quantity) END FROM lineitem WHERE l_partkey = p_partkey AND l_discount BETWEEN 0.01 AND 0.09) AS sold,
  (SELECT coalesce(max(lower(l_returnflag)), 'none') FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus <> 'F') AS last_flag,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size IN (10, 20, 30) THEN 'size ' || p_size END AS size_class,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey) AS lines FROM part"""


def x5_cast_failures(spark, sf):
    rules = [
        apply.Rule("priority", "substring(o_orderpriority, 1, 1)", "int"), apply.Rule("label", "o_orderpriority", "int"),
        apply.Rule("status", "nullif(o_orderstatus, 'O')", "double"), apply.Rule("order_date", "o_orderdate", "date"),
    ]
    return apply.cast_failures(table(spark, sf, "orders"), rules)


X5 = """SELECT 'priority' AS target, 'int' AS data_type, count(*) FILTER (WHERE TRY_CAST(substring(o_orderpriority, 1, 1) AS INT) IS NULL) AS n_failed FROM orders
UNION ALL SELECT 'label', 'int', count(*) FILTER (WHERE TRY_CAST(o_orderpriority AS INT) IS NULL) FROM orders
UNION ALL SELECT 'status', 'double', count(*) FILTER (WHERE o_orderstatus <> 'O' AND TRY_CAST(o_orderstatus AS DOUBLE) IS NULL) FROM orders
UNION ALL SELECT 'order_date', 'date', 0 FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)"""

# --- merge and reports -----------------------------------------------------------------------------------------

MERGED_SQL = f"""{MAPPING_ITEMS_SQL},
src AS (SELECT request_id, target_column, s, min((pos, ix)) AS first_at FROM
         (SELECT request_id, target_column, pos, unnest(source_columns) AS s, generate_subscripts(source_columns, 1) AS ix FROM mapping_items) GROUP BY ALL),
lists AS (SELECT request_id, target_column, list(s ORDER BY first_at) AS sources FROM src GROUP BY ALL),
merged AS (SELECT m.request_id, m.target_column,
    CASE WHEN count(*) = 1 THEN any_value(source_columns) ELSE any_value(sources) END AS source_columns,
    max(confidence_score) AS confidence_score, arg_max(match_type, pos) AS match_type, arg_max(reasoning, pos) AS reasoning,
    arg_max(transformation_rule, pos) FILTER (WHERE transformation_rule IS NOT NULL) AS transformation_rule, min(pos) AS pos
  FROM mapping_items m JOIN lists USING (request_id, target_column) GROUP BY m.request_id, m.target_column)"""


def _text_sources(df):
    return df.withColumn("source_columns", F.array_join("source_columns", "|"))


def n13_merge_duplicates(spark, sf):
    return _text_sources(mapping.merge_duplicates(mapping_items(spark, sf)))


N13 = f"WITH {MERGED_SQL} SELECT * REPLACE (array_to_string(source_columns, '|') AS source_columns) FROM merged"


def _results(spark, sf):
    """Unmapped targets of the review: one per supplier, under the table of its nation."""
    s = table(spark, sf, "supplier")
    target = F.when(F.col("s_nationkey") == 0, F.col("s_name")).otherwise(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_name")))
    return s.select(
        (F.col("s_suppkey") % ITEM_REQUESTS).cast("string").alias("request_id"), F.array(target).alias("unmapped_target_columns"),
        F.array(F.concat(F.lit("src."), "s_name")).alias("unmapped_source_columns"),
    )


REVIEW_SQL = f"""{MERGED_SQL},
unmapped AS (SELECT CAST(s_suppkey % {ITEM_REQUESTS} AS VARCHAR) AS request_id, CASE WHEN s_nationkey = 0 THEN s_name ELSE 'Brand#' || s_nationkey || '.' || s_name END AS target_column FROM supplier),
review AS (SELECT request_id, target_column, source_columns, confidence_score, match_type, reasoning, transformation_rule, 'pending' AS status, pos FROM merged
  UNION ALL SELECT request_id, target_column, [], 0.0, '', NULL, NULL, 'pending', NULL FROM unmapped),
graded AS (SELECT *, len(source_columns) > 0 AS mapped,
    CASE WHEN contains(target_column, '.') THEN regexp_replace(target_column, '\\.[^.]*$', '') ELSE 'Mappings' END AS target_table,
    string_split(target_column, '.')[-1] AS short,
    CAST(floor(CASE WHEN confidence_score <= 1 THEN confidence_score * 100 ELSE confidence_score END + 0.5) AS BIGINT) AS percent FROM review)"""


def _review(spark, sf):
    return mapping.review_rows(mapping.merge_duplicates(mapping_items(spark, sf)), _results(spark, sf))


def g1_review_rows(spark, sf):
    return _text_sources(_review(spark, sf)).select("request_id", "target_column", "source_columns", "confidence_score", "match_type", "status")


G1 = f"WITH {REVIEW_SQL} SELECT request_id, target_column, array_to_string(source_columns, '|') AS source_columns, confidence_score, match_type, status FROM review"


def g2_g3_unmapped_rows(spark, sf):
    return mapping.unmapped_only(_review(spark, sf)).select("request_id", "target_column", "status")


G2_G3 = f"WITH {REVIEW_SQL} SELECT request_id, target_column, status FROM graded WHERE NOT mapped"


def g4_g5_confidence(spark, sf):
    """Scores from price ratios, on both sides of 1."""
    score = F.col("p_retailprice") / F.lit(1000.0) * F.col("p_size") / F.lit(20.0)
    percent = confidence_percent(score)
    return table(spark, sf, "part").select("p_partkey", percent.alias("percent"), confidence_band(percent).alias("band"))


G4_G5 = """WITH s AS (SELECT p_partkey, p_retailprice / 1000.0 * p_size / 20.0 AS score FROM part),
p AS (SELECT p_partkey, CAST(floor(CASE WHEN score <= 1 THEN score * 100 ELSE score END + 0.5) AS BIGINT) AS percent FROM s)
SELECT *, CASE WHEN percent >= 80 THEN 'high' WHEN percent >= 50 THEN 'medium' ELSE 'low' END AS band FROM p"""


def g6_qualified_names(spark, sf):
    """Host names of pages as qualified names of several parts."""
    name = F.regexp_extract("url", r"https?://([^/]*)", 1)
    return table(spark, sf, "pages").select("page_id", table_part(name).alias("table_name"), column_part(name).alias("column_name"))


G6 = """WITH n AS (SELECT page_id, regexp_extract(url, 'https?://([^/]*)', 1) AS h FROM pages)
SELECT page_id, CASE WHEN contains(h, '.') THEN regexp_replace(h, '\\.[^.]*$', '') ELSE 'Mappings' END AS table_name, string_split(h, '.')[-1] AS column_name FROM n"""


def g7_table_report(spark, sf):
    return mapping.table_report(_review(spark, sf))


REPORT_SQL = """report AS (SELECT request_id, target_table, count(*) FILTER (WHERE mapped) AS n_mapped, count(*) FILTER (WHERE NOT mapped) AS n_unmapped, count(*) AS n_total,
  coalesce(CAST(sum(percent) FILTER (WHERE mapped) AS DOUBLE) / nullif(count(*) FILTER (WHERE mapped), 0), 0) AS mean FROM graded GROUP BY request_id, target_table)"""
G7 = f"""WITH {REVIEW_SQL}, {REPORT_SQL}
SELECT request_id, target_table, n_mapped, n_unmapped, n_total, CAST(floor(mean + 0.5) AS BIGINT) AS mean_percent,
  CASE WHEN mean >= 80 THEN 'high' WHEN mean >= 50 THEN 'medium' ELSE 'low' END AS band FROM report"""


def g8_source_tables(spark, sf):
    report = mapping.table_report_with_sources(_review(spark, sf))
    return report.select("request_id", "target_table", F.array_join("source_tables", "|").alias("source_tables"), "n_total")


G8 = f"""WITH {REVIEW_SQL}, s AS (SELECT request_id, target_table, unnest(source_columns) AS c FROM graded WHERE mapped),
t AS (SELECT DISTINCT request_id, target_table, split_part(c, '.', 1) AS st FROM s WHERE position('.' IN c) > 1),
a AS (SELECT request_id, target_table, string_agg(st, '|' ORDER BY st) AS source_tables FROM t GROUP BY ALL),
n AS (SELECT request_id, target_table, count(*) AS n_total FROM graded GROUP BY ALL)
SELECT request_id, target_table, coalesce(source_tables, '') AS source_tables, n_total FROM n LEFT JOIN a USING (request_id, target_table)"""


def g9_summary_cards(spark, sf):
    return mapping.summary_cards(_review(spark, sf))


G9 = f"""WITH {REVIEW_SQL} SELECT request_id, count(*) FILTER (WHERE mapped) AS n_mapped, count(*) FILTER (WHERE NOT mapped) AS n_unmapped,
  CAST(floor(CAST(sum(percent) FILTER (WHERE mapped) AS DOUBLE) / count(*) FILTER (WHERE mapped) + 0.5) AS BIGINT) AS mean_percent FROM graded GROUP BY 1"""


def g10_unmapped_lists(spark, sf):
    return mapping.unmapped_targets(_review(spark, sf), _results(spark, sf))


G10 = f"WITH {REVIEW_SQL} SELECT DISTINCT request_id, target_column FROM (SELECT request_id, target_column FROM unmapped UNION ALL SELECT request_id, target_column FROM graded WHERE NOT mapped)"


def g11_unmapped_count(spark, sf):
    return mapping.unmapped_count(_review(spark, sf))


G11 = f"WITH {REVIEW_SQL} SELECT request_id, count(*) FILTER (WHERE NOT mapped) AS n_unmapped FROM graded GROUP BY 1"


def g12_rule_lineage(spark, sf):
    """Rules over part words, against the catalogue of those words."""
    items = mapping_items(spark, sf).withColumn(
        "transformation_rule",
        F.concat(F.lit("CONCAT(T."), F.upper(F.split_part("transformation_rule", F.lit("("), F.lit(2))), F.lit(", ' red small ', CASE WHEN large > 1 THEN 1 END)")),
    )
    items = items.withColumn("transformation_rule", F.replace("transformation_rule", F.lit("),"), F.lit(",")))
    words = table(spark, sf, "part").select((F.col("p_partkey") % ITEM_REQUESTS).cast("string").alias("request_id"), F.explode(F.split("p_name", " ")).alias("qualified"))
    lineage = mapping.rule_lineage(items, words)
    return lineage.groupBy("request_id", "target_column", "source_column").agg(F.count("*").alias("n"))


G12 = f"""WITH {MAPPING_ITEMS_SQL}, w AS (SELECT DISTINCT CAST(p_partkey % {ITEM_REQUESTS} AS VARCHAR) AS request_id, unnest(string_split(p_name, ' ')) AS q FROM part),
r AS (SELECT request_id, target_column, source_columns[2] AS first_word FROM mapping_items WHERE transformation_rule IS NOT NULL),
n AS (SELECT request_id, target_column, first_word AS name FROM r UNION SELECT request_id, target_column, 'large' FROM r)
SELECT n.request_id, target_column, q AS source_column, CAST(count(DISTINCT q) AS BIGINT) AS n FROM n JOIN w ON name = q AND n.request_id = w.request_id GROUP BY 1, 2, 3"""

# --- edits -----------------------------------------------------------------------------------------------------


def _row_of(part):
    """Request and target of a part's row; requests use the same targets."""
    return (part % ITEM_REQUESTS).cast("string").alias("request_id"), F.concat(F.lit("p."), F.floor(part / ITEM_REQUESTS).cast("string")).alias("target_column")


def _edits(spark, sf):
    """An edit log from line items: every line of a part edits that part's row."""
    li = table(spark, sf, "lineitem")
    action = F.element_at(F.array(*[F.lit(a) for a in ("toggle", "toggle", "set", "validate", "rollback", "unmap", "toggle")]), F.col("l_linenumber"))
    payload = F.struct(
        F.when(action == "toggle", F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string"))).alias("column"),
        F.when(action == "set", F.when(F.col("l_quantity") % 2 == 0, F.lit(" manual ")).otherwise("")).alias("match_type"),
        F.when(action == "set", F.col("l_quantity") * 3 - 10).alias("confidence"),
        F.when(action == "set", F.when(F.col("l_returnflag") == "A", F.lit("  ")).otherwise(F.concat(F.lit(" f"), F.col("l_linenumber").cast("string")))).alias("rule"),
    )
    return li.select(
        *_row_of(F.col("l_partkey")),
        (F.col("l_orderkey") * 80_000 + F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("seq"), action.alias("action"), F.to_json(payload).alias("payload"),
    )


def _part_rows(spark, sf):
    """One review row per part, some without a source or an original."""
    part = table(spark, sf, "part")
    mapped = F.col("p_size") > 5
    rows = part.select(
        *_row_of(F.col("p_partkey")),
        F.when(mapped, F.array(F.lit("c1"), F.col("p_type"))).otherwise(F.array().cast("array<string>")).alias("source_columns"),
        F.when(mapped, F.col("p_size") / F.lit(50.0)).otherwise(0.0).alias("confidence_score"),
        F.when(mapped, F.lit("semantic")).otherwise("").alias("match_type"),
        F.when(mapped, F.col("p_name")).alias("reasoning"), F.when(mapped, F.lit("trim(x)")).alias("transformation_rule"),
        F.lit("pending").alias("status"), mapped.alias("mapped"),
    )
    fields = ("source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")
    return rows.withColumn("original", F.when(F.col("mapped"), F.struct(*fields))).drop("mapped")


def _one_kind(spark, sf, *actions):
    return edits.apply_edits(_part_rows(spark, sf), _edits(spark, sf).filter(F.col("action").isin(*actions)))


EDIT_SQL = f"""edits AS (SELECT (l_partkey % {ITEM_REQUESTS}) || '/p.' || (l_partkey // {ITEM_REQUESTS}) AS target_column, l_orderkey * 80000 + l_suppkey * 8 + l_linenumber AS seq,
  (['toggle', 'toggle', 'set', 'validate', 'rollback', 'unmap', 'toggle'])[l_linenumber] AS action, l_quantity, l_returnflag, l_linenumber, 'c' || (l_suppkey % 3) AS col FROM lineitem),
rows AS (SELECT (p_partkey % {ITEM_REQUESTS}) || '/p.' || (p_partkey // {ITEM_REQUESTS}) AS target_column, p_size > 5 AS mapped, CASE WHEN p_size > 5 THEN ['c1', p_type] ELSE [] END AS source_columns,
  CASE WHEN p_size > 5 THEN p_size / 50.0 ELSE 0 END AS confidence_score, CASE WHEN p_size > 5 THEN 'semantic' ELSE '' END AS match_type,
  CASE WHEN p_size > 5 THEN p_name END AS reasoning, CASE WHEN p_size > 5 THEN 'trim(x)' END AS transformation_rule FROM part)"""


def _edited(df):
    """Rows under request and target as one text."""
    return df.select(F.concat_ws("/", "request_id", "target_column").alias("target_column"), F.array_join("source_columns", "|").alias("source_columns"), "confidence_score", "match_type", "reasoning", "transformation_rule", "status")


def e1_validate(spark, sf):
    return _edited(_one_kind(spark, sf, "validate"))


E1 = f"""WITH {EDIT_SQL} SELECT target_column, array_to_string(source_columns, '|') AS source_columns, confidence_score, match_type, reasoning, transformation_rule,
  CASE WHEN target_column IN (SELECT target_column FROM edits WHERE action = 'validate') THEN 'validated' ELSE 'pending' END AS status FROM rows"""


def e2_e3_resets(spark, sf):
    return _edited(_one_kind(spark, sf, "validate", "rollback", "unmap"))


E2_E3 = f"""WITH {EDIT_SQL}, last AS (SELECT target_column, arg_max(action, seq) AS last,
    coalesce(arg_max(action, seq) FILTER (WHERE action <> 'validate'), '') AS reset,
    coalesce(max(seq) FILTER (WHERE action = 'unmap'), -1) AS u FROM edits WHERE action IN ('validate', 'rollback', 'unmap') GROUP BY 1),
j AS (SELECT r.*, last, CASE WHEN reset = 'unmap' OR (NOT mapped AND u >= 0) THEN true ELSE false END AS cleared FROM rows r LEFT JOIN last USING (target_column))
SELECT target_column, CASE WHEN cleared THEN '' ELSE array_to_string(source_columns, '|') END AS source_columns, CASE WHEN cleared THEN 0 ELSE confidence_score END AS confidence_score,
  CASE WHEN cleared THEN '' ELSE match_type END AS match_type, CASE WHEN cleared THEN NULL ELSE reasoning END AS reasoning,
  CASE WHEN cleared THEN NULL ELSE transformation_rule END AS transformation_rule, CASE WHEN last = 'validate' THEN 'validated' ELSE 'pending' END AS status FROM j"""


def e4_toggle_sources(spark, sf):
    """Source lists after toggles only."""
    return _edited(_one_kind(spark, sf, "toggle")).select("target_column", "source_columns")


E4 = f"""WITH {EDIT_SQL}, t AS (SELECT target_column, col, count(*) AS n, max(seq) AS last FROM edits WHERE action = 'toggle' GROUP BY ALL),
b AS (SELECT target_column, unnest(source_columns) AS col, generate_subscripts(source_columns, 1) AS ix FROM rows),
present AS (
  SELECT b.target_column, b.col, 0 AS late, ix AS ord FROM b LEFT JOIN t USING (target_column, col) WHERE t.n IS NULL
  UNION ALL SELECT t.target_column, t.col, 1, t.last FROM t LEFT JOIN b USING (target_column, col) WHERE (n + CASE WHEN b.ix IS NULL THEN 0 ELSE 1 END) % 2 = 1),
l AS (SELECT target_column, string_agg(col, '|' ORDER BY late, ord) AS s FROM present GROUP BY 1)
SELECT r.target_column, coalesce(s, '') AS source_columns FROM rows r LEFT JOIN l USING (target_column)"""


def e5_set_metadata(spark, sf):
    return _edited(_one_kind(spark, sf, "set"))


E5 = f"""WITH {EDIT_SQL}, s AS (SELECT target_column, arg_max((l_quantity, l_returnflag, l_linenumber), seq) AS v FROM edits WHERE action = 'set' GROUP BY 1)
SELECT target_column, array_to_string(source_columns, '|') AS source_columns,
  CASE WHEN v IS NULL THEN confidence_score ELSE least(greatest(v[1] * 3 - 10, 0), 100) END AS confidence_score,
  CASE WHEN v IS NULL THEN match_type WHEN v[1] % 2 = 0 THEN 'manual' ELSE '' END AS match_type, reasoning,
  CASE WHEN v IS NULL THEN transformation_rule WHEN v[2] = 'A' THEN NULL ELSE 'f' || v[3] END AS transformation_rule, 'pending' AS status
FROM rows LEFT JOIN s USING (target_column)"""


def e1_e5_all_edits(spark, sf):
    """Mixed log, order-dependent; checked against a row-by-row fold in the tests and, here, by recursion."""
    return _edited(edits.apply_edits(_part_rows(spark, sf), _edits(spark, sf)))


def e1_e5_long_logs(spark, sf):
    """The same log cut into so many chunks that the edits of most rows lie in several."""
    return _edited(edits.apply_edits(_part_rows(spark, sf), _edits(spark, sf), chunks=100))


STATE_AFTER = """
  CASE e.action WHEN 'rollback' THEN CASE WHEN mapped THEN o_sources ELSE s.sources END WHEN 'unmap' THEN []
    WHEN 'toggle' THEN CASE WHEN list_contains(s.sources, e.col) THEN list_filter(s.sources, lambda x: x <> e.col) ELSE list_append(s.sources, e.col) END
    ELSE s.sources END"""
E1_E5 = f"""WITH RECURSIVE {EDIT_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY target_column ORDER BY seq) AS n FROM edits),
s AS (
  SELECT target_column, CAST(0 AS BIGINT) AS n, mapped, source_columns AS o_sources, confidence_score AS o_conf, reasoning AS o_reason,
    CAST(source_columns AS VARCHAR[]) AS sources, CAST(confidence_score AS DOUBLE) AS conf, CAST(match_type AS VARCHAR) AS mt, CAST(reasoning AS VARCHAR) AS reason,
    CAST(transformation_rule AS VARCHAR) AS rule, 'pending' AS status FROM rows
  UNION ALL
  SELECT target_column, n, mapped, o_sources, o_conf, o_reason, ns,
    CASE WHEN reset THEN CASE WHEN mapped THEN o_conf ELSE conf END WHEN empties THEN 0 WHEN action = 'set' THEN least(greatest(l_quantity * 3 - 10, 0), 100) ELSE conf END,
    CASE WHEN reset THEN CASE WHEN mapped THEN 'semantic' ELSE mt END WHEN empties THEN '' WHEN action = 'set' THEN CASE WHEN l_quantity % 2 = 0 THEN 'manual' ELSE '' END
         WHEN action = 'toggle' AND mt = '' THEN 'semantic' ELSE mt END,
    CASE WHEN reset THEN CASE WHEN mapped THEN o_reason ELSE reason END WHEN empties THEN NULL ELSE reason END,
    CASE WHEN reset THEN CASE WHEN mapped THEN 'trim(x)' ELSE rule END WHEN empties THEN NULL WHEN action = 'set' THEN CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'f' || l_linenumber END ELSE rule END,
    CASE WHEN action = 'validate' THEN 'validated' ELSE 'pending' END
  FROM (SELECT s.target_column, e.n, s.mapped, s.o_sources, s.o_conf, s.o_reason, s.conf, s.mt, s.reason, s.rule, e.action, e.l_quantity, e.l_returnflag, e.l_linenumber,
          e.action = 'rollback' AS reset, {STATE_AFTER} AS ns,
          e.action = 'unmap' OR (e.action = 'toggle' AND len({STATE_AFTER}) = 0) AS empties
        FROM s JOIN numbered e ON e.target_column = s.target_column AND e.n = s.n + 1))
SELECT target_column, array_to_string(sources, '|') AS source_columns, conf AS confidence_score, mt AS match_type, reason AS reasoning, rule AS transformation_rule, status
FROM s QUALIFY row_number() OVER (PARTITION BY target_column ORDER BY n DESC) = 1"""

# --- exports ---------------------------------------------------------------------------------------------------


def _merged(spark, sf):
    return mapping.merge_duplicates(mapping_items(spark, sf))


def k1_result_documents(spark, sf):
    """Documents of 25 requests; parts are the items of seven of them, the others have none."""
    part = table(spark, sf, "part")
    items = part.select(
        (F.col("p_size") % 7).cast("string").alias("request_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("t.c"), F.col("p_partkey").cast("string")).alias("target_column"),
        F.array(F.col("p_type")).alias("source_columns"), F.lit(0.5).alias("confidence_score"), F.lit("exact").alias("match_type"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("transformation_rule"),
    )
    nothing = F.array().cast("array<string>")
    results = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("request_id"), nothing.alias("unmapped_source_columns"), nothing.alias("unmapped_target_columns"), F.lit(0.25).alias("global_confidence"), F.col("n_name").alias("analysis_summary")
    )
    documents = exports.result_documents(items, results)
    return documents.select("request_id", F.char_length("json").cast("bigint").alias("n_chars"), F.md5("json").alias("digest"))


K1_DOCUMENTS = """WITH i AS (SELECT p_size % 7 AS r, string_agg('{"target_column":"t.c' || p_partkey || '","source_columns":["' || p_type || '"],"confidence_score":0.5,"match_type":"exact","reasoning":null,"transformation_rule":null}', ',' ORDER BY p_partkey) AS items FROM part GROUP BY 1),
d AS (SELECT CAST(n_nationkey AS VARCHAR) AS request_id, '{"mappings":[' || coalesce(items, '') || '],"unmapped_source_columns":[],"unmapped_target_columns":[],"global_confidence":0.25,"analysis_summary":"' || n_name || '"}' AS json FROM nation LEFT JOIN i ON r = n_nationkey)
SELECT request_id, length(json) AS n_chars, md5(json) AS digest FROM d"""


def k1_mapping_json(spark, sf):
    """Item objects, read back field by field."""
    text = exports.item_json(_merged(spark, sf))
    parsed = F.from_json("json", "target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string").alias("j")
    back = text.select(F.col("request_id").alias("request"), parsed, F.array_join(F.json_object_keys("json"), ",").alias("keys")).select("request", "keys", "j.*")
    return _text_sources(back.withColumnRenamed("request", "request_id"))


K1 = f"""WITH {MERGED_SQL} SELECT request_id, 'target_column,source_columns,confidence_score,match_type,reasoning,transformation_rule' AS keys, target_column,
  array_to_string(source_columns, '|') AS source_columns, confidence_score, match_type, reasoning, transformation_rule FROM merged"""


def k2_mapping_csv(spark, sf):
    return exports.csv_rows(_review(spark, sf))


DETAIL = "CASE WHEN mapped THEN {} ELSE '—' END"
K2 = f"""WITH {REVIEW_SQL} SELECT {DETAIL.format("array_to_string(source_columns, '; ')")} AS "Source", target_column AS "Target",
  {DETAIL.format("coalesce(nullif(match_type, ''), 'semantic')")} AS "Type", {DETAIL.format("percent || '%'")} AS "Confidence",
  coalesce(nullif(transformation_rule, ''), CASE WHEN mapped THEN 'direct' ELSE '—' END) AS "Transformation",
  CASE WHEN NOT mapped THEN 'Unmapped' WHEN status = 'validated' THEN 'Validated' ELSE 'Pending' END AS "Status", coalesce(reasoning, '') AS "Reasoning" FROM graded"""


def k3_sql_text(spark, sf):
    return exports.sql_statements(_merged(spark, sf)).select("request_id", "pos", "value")


_SRC = "array_to_string(source_columns, ', ')"
K3 = f"""WITH {MERGED_SQL} SELECT request_id, pos, '-- ' || {_SRC} || ' -> ' || target_column || ' (' || match_type || ', '
  || CASE WHEN confidence_score = floor(confidence_score) THEN CAST(CAST(confidence_score AS BIGINT) AS VARCHAR) ELSE CAST(confidence_score AS VARCHAR) END || '%)' || chr(10)
  || 'SELECT ' || coalesce(nullif(transformation_rule, ''), {_SRC}) || ' AS ' || string_split(target_column, '.')[-1] || ';' || chr(10) AS value FROM merged"""


def k3_table_selects(spark, sf):
    return exports.table_select_lines(_merged(spark, sf)).select("request_id", "target_table", F.col("block").cast("bigint").alias("block"), "value")


K3_TABLES = f"""WITH {REVIEW_SQL}, m AS (SELECT * FROM graded WHERE mapped),
t AS (SELECT DISTINCT request_id, target_table, CASE WHEN contains(c, '.') THEN split_part(c, '.', 1) ELSE 'Mappings' END AS name FROM (SELECT request_id, target_table, unnest(source_columns) AS c FROM m))
SELECT request_id, target_table, CAST(0 AS BIGINT) AS block, CASE WHEN pos = min(pos) OVER (PARTITION BY request_id, target_table) THEN 'SELECT ' ELSE '     , ' END
  || coalesce(transformation_rule, {_SRC}) || ' AS ' || short AS value FROM m
UNION ALL SELECT request_id, target_table, 1, CASE WHEN name = min(name) OVER (PARTITION BY request_id, target_table) THEN 'FROM ' ELSE '   , ' END || name FROM t"""


def k4_script_text(spark, sf):
    """Every fourth rule is written with CONVERT and a bare VARCHAR, which the script has in Spark's spelling."""
    items = _merged(spark, sf)
    rule = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("CONVERT(VARCHAR, "), F.col("transformation_rule"), F.lit(")"))).otherwise(F.col("transformation_rule"))
    return exports.script_lines(items.withColumn("transformation_rule", rule)).select("request_id", "pos", "value")


K4 = f"""WITH {MERGED_SQL} SELECT request_id, pos, CASE WHEN transformation_rule IS NOT NULL THEN '    .withColumn("' || string_split(target_column, '.')[-1] || '", F.expr("'
    || CASE WHEN pos % 4 = 0 THEN 'CAST(' || transformation_rule || ' AS STRING)' ELSE transformation_rule END || '"))'
  ELSE '    .withColumnRenamed("' || string_split(source_columns[1], '.')[-1] || '", "' || string_split(target_column, '.')[-1] || '")' END AS value FROM merged"""


def k5_report_details(spark, sf):
    return exports.report_tables(_review(spark, sf), _results(spark, sf))["details"]


K5 = f"""WITH {REVIEW_SQL} SELECT request_id, target_table, {DETAIL.format("array_to_string(source_columns, ', ')")} AS source, short AS target,
  {DETAIL.format("coalesce(nullif(match_type, ''), 'semantic')")} AS match_type, {DETAIL.format("percent || '%'")} AS confidence,
  {DETAIL.format("coalesce(nullif(transformation_rule, ''), 'direct')")} AS rule, CASE WHEN NOT mapped THEN 'Unmapped' ELSE 'Pending' END AS status,
  CASE WHEN mapped THEN nullif(trim(reasoning), '') END AS reasoning FROM graded"""


def k5_report_unmapped(spark, sf):
    return exports.report_tables(_review(spark, sf), _results(spark, sf))["unmapped"]


K5_UNMAPPED = f"""WITH {REVIEW_SQL} SELECT CAST(s_suppkey % {ITEM_REQUESTS} AS VARCHAR) AS request_id, 'src.' || s_name AS column_name, 'source' AS side FROM supplier
UNION ALL SELECT DISTINCT request_id, target_column, 'target' FROM graded WHERE NOT mapped"""


def k6_session_payloads(spark, sf):
    """Customers as sessions whose structured columns are encoded as JSON text."""
    c = table(spark, sf, "customer")
    some = F.col("c_acctbal") > 0
    structured = c.select(
        "c_custkey",
        F.when(some, F.array(F.struct(F.col("c_name").alias("fileName"), F.col("c_mktsegment").alias("content")))).alias("source_files"),
        F.when(some, F.struct(F.col("c_nationkey").alias("n"), F.lit(None).cast("string").alias("m"))).alias("current_mapping"),
    )
    return exports.session_payloads(structured, {"source_files": "source_files_json", "current_mapping": "current_mapping_json"})


K6 = """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '[{"fileName":"' || c_name || '","content":"' || c_mktsegment || '"}]' ELSE '[]' END AS source_files_json,
  CASE WHEN c_acctbal > 0 THEN '{"n":' || c_nationkey || ',"m":null}' END AS current_mapping_json FROM customer"""

QUERIES = {
    "x1_x6_project_mapping": (x1_x6_project_mapping, X1),
    "x2_chain_mapping": (x2_chain_mapping, X2),
    "x3_multi_source_mapping": (x3_multi_source_mapping, X3),
    "x4_rule_language": (x4_rule_language, X4),
    "x_files_to_rows": (x_files_to_rows, X_FILES),
    "x4_query_rules": (x4_query_rules, X4_QUERIES),
    "x4_aggregate_rules": (x4_aggregate_rules, X4_AGG),
    "x5_cast_failures": (x5_cast_failures, X5),
    "n13_u3_merge_duplicates": (n13_merge_duplicates, N13),
    "g1_review_rows": (g1_review_rows, G1),
    "g2_g3_unmapped_rows": (g2_g3_unmapped_rows, G2_G3),
    "g4_g5_confidence": (g4_g5_confidence, G4_G5),
    "g6_qualified_names": (g6_qualified_names, G6),
    "g7_table_report": (g7_table_report, G7),
    "g8_source_tables": (g8_source_tables, G8),
    "g9_summary_cards": (g9_summary_cards, G9),
    "g10_unmapped_lists": (g10_unmapped_lists, G10),
    "g11_unmapped_count": (g11_unmapped_count, G11),
    "g12_rule_lineage": (g12_rule_lineage, G12),
    "e1_validate": (e1_validate, E1),
    "e2_e3_resets": (e2_e3_resets, E2_E3),
    "e4_toggle_sources": (e4_toggle_sources, E4),
    "e5_set_metadata": (e5_set_metadata, E5),
    "e1_e5_all_edits": (e1_e5_all_edits, E1_E5),
    "e1_e5_long_logs": (e1_e5_long_logs, E1_E5),
    "k1_mapping_json": (k1_mapping_json, K1),
    "k1_result_documents": (k1_result_documents, K1_DOCUMENTS),
    "k2_mapping_csv": (k2_mapping_csv, K2),
    "k3_sql_text": (k3_sql_text, K3),
    "k3_table_selects": (k3_table_selects, K3_TABLES),
    "k4_script_text": (k4_script_text, K4),
    "k5_report_details": (k5_report_details, K5),
    "k5_report_unmapped": (k5_report_unmapped, K5_UNMAPPED),
    "k6_session_payloads": (k6_session_payloads, K6),
}
