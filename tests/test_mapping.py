import json
import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import apply, edits, mapping
from colweave.sources import exports

ITEM = "request_id string, target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string, pos bigint"


def items(spark, *rows):
    return spark.createDataFrame([("0", *r, i) for i, r in enumerate(rows)], ITEM)


def test_merge_is_idempotent_and_unique(spark):
    rng = random.Random(3)
    rows = [
        (f"t{rng.randrange(20)}.c", [rng.choice("abcd") for _ in range(rng.randrange(3))], rng.random(), rng.choice(["exact", "derived"]), rng.choice(["", "r"]), rng.choice([None, "f", "g"]))
        for _ in range(200)
    ]
    once = mapping.merge_duplicates(items(spark, *rows))
    twice = mapping.merge_duplicates(once)
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(once) == as_rows(twice)
    expected = {}
    for target, sources, score, kind, reason, rule in rows:
        if target not in expected:
            expected[target] = [list(sources), score, kind, reason, rule]
        else:
            e = expected[target]
            expected[target] = [list(dict.fromkeys(e[0] + sources)), max(e[1], score), kind, reason, rule or e[4]]
    got = {r["target_column"]: [r["source_columns"] or [], r["confidence_score"], r["match_type"], r["reasoning"], r["transformation_rule"]] for r in once.collect()}
    assert got == expected


def test_reports_add_up(spark):
    rows = items(spark, ("a.x", ["s.c", "q.d", "plain", ".z"], 0.9, "exact", None, None), ("a.y", [], 0.0, "", None, None), ("b", ["s.c"], 75.4, "", " why ", "f"))
    rows = rows.withColumn("status", F.lit("pending"))
    report = {r["target_table"]: r for r in mapping.table_report_with_sources(rows).collect()}
    assert (report["a"]["n_mapped"], report["a"]["n_unmapped"], report["a"]["n_total"], report["a"]["mean_percent"], report["a"]["band"]) == (1, 1, 2, 90, "high")
    assert report["a"]["source_tables"] == ["q", "s"]
    assert (report["Mappings"]["mean_percent"], report["Mappings"]["band"]) == (75, "medium")
    card = mapping.summary_cards(rows).first()
    assert (card["n_mapped"], card["n_unmapped"], card["mean_percent"]) == (2, 1, 83)


def test_lineage_skips_literals(spark):
    rows = items(spark, ("t", ["s.a"], 1.0, "", None, "CONCAT(S.A, 'b', c) || t.d || DATE"))
    catalog = spark.createDataFrame([("0", c) for c in ("s.a", "b", "c", "d", "date", "e")], "request_id string, qualified string")
    assert {r["source_column"] for r in mapping.rule_lineage(rows, catalog).collect()} == {"s.a", "c", "d"}


# --- edits against a plain fold -----------------------------------------------------------------------------------

ROW = "request_id string, target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string, status string, original struct<source_columns:array<string>,confidence_score:double,match_type:string,reasoning:string,transformation_rule:string>"
FIELDS = ("source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")


def plain_fold(row, log):
    s = dict(row)
    for _, action, p in sorted(log, key=lambda e: e[0]):
        s["status"] = "validated" if action == "validate" else "pending"
        if action == "rollback" and row["original"]:
            s.update(row["original"])
        elif action == "unmap":
            s.update(zip(FIELDS, ([], 0.0, "", None, None)))
        elif action == "toggle":
            c = p["column"]
            s["source_columns"] = [x for x in s["source_columns"] if x != c] if c in s["source_columns"] else s["source_columns"] + [c]
            if not s["source_columns"]:
                s.update(zip(FIELDS[1:], (0.0, "", None, None)))
            else:
                s["match_type"] = s["match_type"] or "semantic"
        elif action == "set":
            s["match_type"] = (p.get("match_type") or "").strip()
            s["confidence_score"] = min(100.0, max(0.0, p.get("confidence") or 0.0))
            s["transformation_rule"] = (p.get("rule") or "").strip() or None
    return [s[f] for f in FIELDS] + [s["status"]]


@pytest.mark.parametrize("limits", [{}, {"chunks": 40}, {"chunks": 1000}])
def test_edits_equal_one_by_one_application(spark, limits):
    rng = random.Random(11)
    rows, logs = [], {}
    for i in range(150):
        mapped = rng.random() < 0.7
        sources = [rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(1, 4))] if mapped else []
        original = dict(zip(FIELDS, (sources, 0.5, "exact", "why", "f"))) if mapped else None
        base = original or dict(zip(FIELDS, ([], 0.0, "", None, None)))
        rows.append({"request_id": "0", "target_column": f"t{i}", **base, "status": "pending", "original": original})
        log = []
        for seq in rng.sample(range(1, 60), rng.randrange(0, 25)):
            action = rng.choice(["toggle"] * 5 + ["set", "validate", "rollback", "unmap"] if rng.random() < 0.5 else ["toggle", "set"])
            payload = {}
            if action == "toggle":
                payload = {"column": rng.choice("abc")}
            elif action == "set":
                payload = {"match_type": rng.choice(["", " manual "]), "confidence": rng.choice([-5.0, 40.0, 400.0, None]), "rule": rng.choice([" ", " g "])}
            log.append((seq, action, payload))
        logs[f"t{i}"] = log
    table = spark.createDataFrame([tuple(r[c] for c in ("request_id", "target_column", *FIELDS, "status")) + ((tuple(r["original"][f] for f in FIELDS)) if r["original"] else None,) for r in rows], ROW)
    edit_rows = [("0", t, seq, a, json.dumps(p)) for t, log in logs.items() for seq, a, p in log]
    log = spark.createDataFrame(edit_rows, "request_id string, target_column string, seq bigint, action string, payload string")
    got = {r["target_column"]: [r[f] for f in FIELDS] + [r["status"]] for r in edits.apply_edits(table, log, **limits).collect()}
    assert got == {r["target_column"]: plain_fold(r, logs[r["target_column"]]) for r in rows}


def test_the_edit_log_is_read_once_and_shuffled_little(spark, tmp_path):
    rows = spark.createDataFrame([("0", f"t{i}", ["a"], 0.5, "exact", None, None, "pending", None) for i in range(9)], ROW)
    log = spark.range(90).selectExpr("'0' as request_id", "concat('t', id % 10) as target_column", "id as seq", "'toggle' as action", "concat('{\"column\":\"c', id % 3, '\"}') as payload")
    log.write.parquet(str(tmp_path / "log"))
    out = edits.apply_edits(rows, spark.read.parquet(str(tmp_path / "log")), chunks=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and str(tmp_path) not in plan
    assert out.count() == 9


def test_the_edit_log_is_sorted_once_and_written_without_what_no_longer_counts(spark, monkeypatch):
    """100 edits each of 40 rows, unmapped at the 95th: 5 toggles and the unmapping are left of a row; one long log of as many edits is cut."""
    kept = {}
    monkeypatch.setattr(edits, "written", lambda df, name: kept.setdefault(name, df))
    action = "case when id % 100 = 94 then 'unmap' else 'toggle' end as action"
    short = spark.range(4000).selectExpr("'0' as request_id", "concat('t', floor(id / 100)) as target_column", "id as seq", action, "concat('{\"column\":\"c', id % 3, '\"}') as payload")
    long = spark.range(4000).selectExpr("'0' as request_id", "'long' as target_column", "id * id as seq", "'toggle' as action", "concat('{\"column\":\"c', id % 3, '\"}') as payload")
    log = edits._scanned(short.union(long), 8)
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Window [") == 1
    lengths = {(r["target_column"], r["chunk"]): r["count"] for r in log.groupBy("target_column", "chunk").count().collect()}
    whole = {t: n for (t, c), n in lengths.items() if t != "long" and (t, 1) not in lengths}
    assert len(whole) > 20 and set(whole.values()) == {6}
    assert sum(n for (t, _), n in lengths.items() if t == "long") == 4000 and max(lengths.values()) <= 1600 and len([t for t, _ in lengths if t == "long"]) >= 4


def test_edits_may_clear_columns_that_are_never_null(spark):
    rows = spark.range(3).select(
        F.lit("0").alias("request_id"), F.col("id").cast("string").alias("target_column"), F.array(F.lit("c")).alias("source_columns"), F.lit(0.5).alias("confidence_score"),
        F.lit("exact").alias("match_type"), F.lit("r").alias("reasoning"), F.lit("f").alias("transformation_rule"), F.lit("pending").alias("status"),
    )
    rows = rows.withColumn("original", F.struct(*FIELDS))
    log = spark.range(2).select(F.lit("0").alias("request_id"), F.col("id").cast("string").alias("target_column"), F.lit(1).alias("seq"), F.lit("unmap").alias("action"), F.lit("{}").alias("payload"))
    for limits in ({}, {"chunks": 50}):
        got = {r["target_column"]: r["reasoning"] for r in edits.apply_edits(rows, log, **limits).collect()}
        assert got == {"0": None, "1": None, "2": "r"}


# --- applying a mapping -------------------------------------------------------------------------------------------


def test_rules_are_read_from_the_mapping(spark):
    mapped = items(
        spark, ("new.id", ["old.key"], 1.0, "exact", None, "CAST(key AS VARCHAR)"), ("new.name", ["label"], 1.0, "exact", None, None),
        ("new.none", [], 0.0, "", None, None), ("new.bad", ["x"], 0.0, "incompatible", None, "boom("), ("other.c", ["label"], 1.0, "exact", None, None),
    )
    rules = apply.rules_for(mapped, "new", {"id": "string"})
    out = apply.project_mapping(spark.createDataFrame([(1, "a")], "key int, label string"), rules)
    assert out.dtypes == [("id", "string"), ("name", "string")] and out.first() == ("1", "a")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(apply.MappingError):
        apply.rules_for(items(spark, ("t.a", ["x", "y"], 1.0, "derived", None, None)))


def test_projection_and_chain_differ(spark):
    df = spark.createDataFrame([(1, 10)], "a int, b int")
    rules = [apply.Rule("a", "b"), apply.Rule("c", "a + 1")]
    assert apply.project_mapping(df, rules).first() == (10, 2)
    assert apply.chain_mapping(df, rules).first() == (10, 10, 11)


def test_silent_renames_are_refused(spark):
    df = spark.createDataFrame([(1, 10)], "a int, b int")
    with pytest.raises(apply.MappingError, match="no such column"):
        apply.chain_mapping(df, [apply.Rule("x", "`z`", source="z")])
    with pytest.raises(apply.MappingError, match="taken"):
        apply.chain_mapping(df, [apply.Rule("b", "`a`", source="a")])
    with pytest.raises(apply.MappingError, match="repeated"):
        apply.project_mapping(df, [apply.Rule("x", "a"), apply.Rule("x", "b")])


@pytest.mark.parametrize("rule", ["(SELECT 1)", "rand()", "a + uuid()", "SUM(a)", "count (*)", "row_number() OVER (ORDER BY a)", "explode(split(x, ' '))", "first(x)", "count_if(y > 0)", "CURRENT_TIMESTAMP", "current_date", "a; b"])
def test_unsafe_rules_are_refused(rule):
    with pytest.raises(apply.MappingError):
        apply.check_rule(rule)


@pytest.mark.parametrize("rule", ["concat('SELECT ', a)", "t.sum", "'it''s FROM' || b", "min_value", "offset + 1", "limit", "`from`", "TRIM(BOTH ' ' FROM x)", "CASE WHEN a IN (1, 2) THEN (b) END", "CAST(a AS DECIMAL(5, 2))"])
def test_safe_rules_pass(rule):
    apply.check_rule(rule)


@pytest.mark.parametrize(
    "rule",
    ["`explode`(split(x,' '))", "`first`(x)", "`rand`()", "`current_timestamp`()", "now()", "current_date", "sum(n)", "uuid()", "row_number() over (order by x)", "(select 1)", "x, n", "missing + 1", "stack(2, 1, 2)", "input_file_name()", "monotonically_increasing_id()"],
)
def test_rules_are_checked_on_their_analysed_plan(spark, rule):
    df = spark.createDataFrame([("a b", 1), ("c d", 2)], "x string, n int")
    with pytest.raises(apply.MappingError):
        apply.project_mapping(df, [apply.Rule("ok", "n"), apply.Rule("t", rule)])
    with pytest.raises(apply.MappingError):
        apply.chain_mapping(df, [apply.Rule("t", rule)])


@pytest.mark.parametrize("rule", ["`explode`(split(x,' '))", "`first`(x)", "`rand`()", '"rand"()'])
def test_quoted_names_cannot_be_called(rule):
    with pytest.raises(apply.MappingError):
        apply.check_rule(rule)


def test_harmless_functions_pass_on_a_table(spark):
    df = spark.createDataFrame([("a b", 1)], "x string, n int")
    rules = [apply.Rule("t", "array_join(transform(split(x, ' '), w -> upper(w)), '-')"), apply.Rule("m", "aggregate(sequence(1, n), 0, (a, b) -> a + b)")]
    assert [tuple(r) for r in apply.project_mapping(df, rules).collect()] == [("A-B", 1)]


def test_every_keyword_of_the_rule_editor_is_accepted_or_refused_with_a_reason():
    from workloads import mapping as workload

    shown = [r.query for r in workload.QUERY_RULES] + list(workload.REFUSED_QUERIES)
    scalar = "CONVERT(VARCHAR, p_partkey) UPPER TRIM LOWER SUBSTRING LIKE NOT NULL REPLACE BIGINT INTEGER DECIMAL DOUBLE BOOLEAN TRUE DATETIME COALESCE"
    aggregate = "COUNT SUM MAX MIN AVG DISTINCT"
    types = "INT FLOAT DATE TIMESTAMP STRING FALSE"
    keywords = (
        "SELECT", "FROM", "WHERE", "AS", "CAST", "COALESCE", "CONCAT", "TRIM", "UPPER", "LOWER", "SUBSTRING", "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "NULL",
        "IS", "IN", "LIKE", "BETWEEN", "JOIN", "LEFT", "RIGHT", "INNER", "ON", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT", "COUNT", "SUM",
        "AVG", "MIN", "MAX", "REPLACE", "CONVERT", "VARCHAR", "INT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL", "DATE", "DATETIME", "TIMESTAMP", "STRING", "BOOLEAN", "TRUE", "FALSE",
    )
    words = set(" ".join([*shown, scalar, aggregate, types, "CAST OR"]).replace("(", " ").replace(")", " ").replace(",", " ").split())
    assert len(keywords) == 59 and set(keywords) <= words


@pytest.mark.parametrize("kind", ["INT", "FLOAT", "DATE", "TIMESTAMP", "STRING", "BIGINT", "VARCHAR", "DATETIME"])
def test_type_names_of_the_editor_work(spark, kind):
    df = spark.createDataFrame([("2024",)], "x string")
    out = apply.project_mapping(df, [apply.Rule("t", apply.to_spark_sql(f"CONVERT({kind}, x) IS NOT NULL AND NOT FALSE"))])
    assert out.first()[0] is True


def test_query_rules_give_one_row_for_each_key(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, keep string")
    lines = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, v int")
    made = apply.query_mapping(rows, {"lines": lines}, [apply.QueryRule("total", "SELECT k, SUM(v) FROM lines GROUP BY k", ("k",)), apply.QueryRule("keep", "SELECT k, 'n' || v FROM lines WHERE v = 5", ("k",))])
    assert sorted(map(tuple, made.collect()), key=lambda r: r[0]) == [(1, 30, None), (2, 5, "n5"), (3, None, None)] and made.columns == ["k", "total", "keep"]
    several = apply.query_mapping(rows, {"lines": lines}, [apply.QueryRule("v", "SELECT k, v FROM lines", ("k",))])
    with pytest.raises(Exception, match="several rows"):
        several.collect()
    assert not spark.catalog.tableExists("lines")
    with pytest.raises(apply.MappingError, match="cannot be found"):
        apply.checked_query(spark, {"lines": lines}, "SELECT k, v FROM elsewhere")
    with pytest.raises(apply.MappingError, match="keys and one value"):
        apply.query_mapping(rows, {"lines": lines}, [apply.QueryRule("v", "SELECT k FROM lines", ("k",))])


def test_rules_on_columns_named_like_keywords(spark):
    df = spark.createDataFrame([(1, "a "), (2, None)], "offset int, `from` string")
    out = apply.project_mapping(df, [apply.Rule("n", "offset + 1"), apply.Rule("t", "upper(trim(`from`))"), apply.Rule("c", apply.quote_name("offset"))])
    assert [tuple(r) for r in out.collect()] == [(2, "A", 1), (3, None, 2)]


def test_rejected_edits_are_listed_and_change_nothing(spark):
    log = spark.createDataFrame(
        [("0", "t.a", 1, "validate", None), ("0", "t.a", 2, "note", None), ("0", "t.a", 3, "toggle", "{}"), ("0", "t.a", None, "unmap", None), ("0", None, 4, "unmap", None)],
        "request_id string, target_column string, seq bigint, action string, payload string",
    )
    rows = spark.createDataFrame([("0", "t.a", ["a"], 0.5, "exact", None, None, "pending", None)], "request_id string, target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string, status string, original struct<source_columns:array<string>,confidence_score:double,match_type:string,reasoning:string,transformation_rule:string>")
    after = edits.apply_edits(rows, log).first()
    assert after["status"] == "validated" and after["source_columns"] == ["a"]
    assert sorted(r["reason"] for r in edits.rejected_edits(log).collect()) == ["no column to toggle", "no row or sequence number", "no row or sequence number", "unknown action"]


def test_sparse_sequence_numbers_are_spread_over_chunks(spark):
    rows = spark.createDataFrame([("0", "t", [], 0.0, "", None, None, "pending", None)], "request_id string, target_column string, source_columns array<string>, confidence_score double, match_type string, reasoning string, transformation_rule string, status string, original struct<source_columns:array<string>,confidence_score:double,match_type:string,reasoning:string,transformation_rule:string>")
    n = 20_001
    log = spark.range(n).selectExpr("'0' as request_id", "'t' as target_column", "1700000000000000 + id * id * 7 as seq", "'toggle' as action", "concat('{\"column\":\"c', id % 2, '\"}') as payload")
    after = edits.apply_edits(rows, log, chunks=40).first()
    assert after["source_columns"] == ["c0"] and after["match_type"] == "semantic"  # 10,001 toggles of c0, 10,000 of c1


def test_a_column_of_rules_is_spelt_like_single_ones(spark):
    rules = [
        "CONVERT(VARCHAR, concat(a, ','))", "convert(decimal(10,2), CONVERT(int, a)) + 1", "CAST(a AS VARCHAR(5))", "upper(CONVERT(VARCHAR, trim(concat(a, (b), 'x)')))) || CONVERT( DATETIME ,b)",
        "CAST(a AS datetime)", "a + 1", "CONVERT(int, CONVERT(bigint, CONVERT(VARCHAR, a)))", "concat('it''s', CONVERT(VARCHAR, a))", "varchar_column", "converted(a, b)",
    ]
    rows = spark.createDataFrame([(r,) for r in rules], "rule string").select("rule", apply.spark_spelling(F.col("rule")).alias("spelt")).collect()
    assert {r["rule"]: r["spelt"] for r in rows} == {r: apply.to_spark_sql(r) for r in rules}
    kept = spark.createDataFrame([("concat('CONVERT(VARCHAR, a)', b)",)], "rule string").select(apply.spark_spelling(F.col("rule"))).first()[0]
    assert kept == "concat('CONVERT(VARCHAR, a)', b)"


def test_rule_spelling():
    assert apply.to_spark_sql("CONVERT(VARCHAR, concat(a, ','))") == "CAST(concat(a, ',') AS STRING)"
    assert apply.to_spark_sql("convert(decimal(10,2), CONVERT(int, a)) + 1") == "CAST(CAST(a AS int) AS decimal(10,2)) + 1"
    assert apply.to_spark_sql("CAST(a AS VARCHAR(5))") == "CAST(a AS VARCHAR(5))"
    assert apply.to_spark_sql("'VARCHAR' || CAST(d AS datetime)") == "'VARCHAR' || CAST(d AS TIMESTAMP)"


def test_cast_failures(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    report = apply.cast_failures(df, [apply.Rule("n", "a", "int"), apply.Rule("s", "a", "string")]).collect()
    assert {(r["target"], r["n_failed"]) for r in report} == {("n", 1), ("s", 0)}


# --- exports ------------------------------------------------------------------------------------------------------


def test_exports_read_back(spark, tmp_path):
    rows = items(spark, ("t.a", ["s.x", "s.y"], 0.9, "derived", 'say "hi"', 'concat(x, "q", y)'), ("t.b", ["s.z"], 1.0, "exact", "", None), ("u", [], 0.0, "", None, None))
    review = rows.withColumn("status", F.lit("validated"))
    exports.write_csv(review, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("Target").collect()
    assert [tuple(r) for r in back] == [
        ("s.x; s.y", "t.a", "derived", "90%", 'concat(x, "q", y)', "Validated", 'say "hi"'), ("s.z", "t.b", "exact", "100%", "direct", "Validated", None), ("—", "u", "—", "—", "—", "Unmapped", None),
    ]
    exports.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    exports.write_sql(rows.filter("pos < 2"), str(tmp_path / "sql"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "sql" / "request_id=0").glob("part-*")))
    assert text.startswith("-- s.x, s.y -> t.a (derived, 0.9%)\nSELECT concat(x,") and "-- s.z -> t.b (exact, 1%)\nSELECT s.z AS b;" in text
    exports.write_script(rows.filter("pos < 2"), str(tmp_path / "py"))
    script = "".join(p.read_text() for p in sorted((tmp_path / "py").glob("part-*")))
    scope = {"df_source": spark.createDataFrame([("1", "2", "3")], "x string, y string, z string")}
    exec(compile(script, "script", "exec"), scope)
    assert scope["df_result"].first() == ("1", "2", "3", "1q2")
    results = spark.createDataFrame([("0", ["s.u"], ["t.v"], 0.5, "ok")], "request_id string, unmapped_source_columns array<string>, unmapped_target_columns array<string>, global_confidence double, analysis_summary string")
    doc = json.loads(exports.result_documents(rows, results).first()["json"])
    assert [m["target_column"] for m in doc["mappings"]] == ["t.a", "t.b", "u"] and doc["mappings"][1]["transformation_rule"] is None
    empty = exports.result_documents(rows.filter("pos < 0"), results).first()
    assert json.loads(empty["json"])["mappings"] == []
    exports.write_report(review, results, str(tmp_path / "report"))
    unmapped = {(r["side"], r["column_name"]) for r in spark.read.parquet(str(tmp_path / "report" / "unmapped")).collect()}
    assert unmapped == {("source", "s.u"), ("target", "t.v"), ("target", "u")}
