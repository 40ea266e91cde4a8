"""Exports of a mapping: JSON, CSV, SQL text, a DataFrame script, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.confidence import column_part, confidence_percent, is_mapped, table_part
from colweave.operators.apply import spark_spelling
from colweave.operators.mapping import (
    detail_rows,
    match_type_or_default,
    review_status,
    rule_or,
    summary_cards,
    table_report,
    unmapped_targets,
)

ITEM_FIELDS = ("target_column", "source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")
KEEP_NULLS = {"ignoreNullFields": "false"}
DASH = "—"


def item_json(items: DataFrame) -> DataFrame:
    """One JSON object per mapping item; works for a mapping of any size."""
    return items.select("request_id", F.to_json(F.struct(*ITEM_FIELDS), KEEP_NULLS).alias("json"))


def result_documents(items: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON document per request, items in mapping order; a request without items has an empty list.

    A document is one text of one mapping, which has a row per column; `item_json` keeps the items apart.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*ITEM_FIELDS).alias("item"))))
    gathered = items.groupBy("request_id").agg(F.transform(ordered, lambda o: o["item"]).alias("mappings"))
    rest = ("unmapped_source_columns", "unmapped_target_columns", "global_confidence", "analysis_summary")
    joined = results.join(gathered, "request_id", "left")
    kind = gathered.schema["mappings"].dataType
    mappings = F.coalesce("mappings", F.array().cast(kind)).alias("mappings")
    return joined.select("request_id", F.to_json(F.struct(mappings, *rest), KEEP_NULLS).alias("json"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The seven fields of the review CSV."""
    mapped, dash = is_mapped(F.col("source_columns")), F.lit(DASH)
    percent = F.concat(confidence_percent(F.col("confidence_score")).cast("string"), F.lit("%"))
    return rows.select(
        F.when(mapped, F.array_join("source_columns", "; ")).otherwise(dash).alias("Source"),
        F.col("target_column").alias("Target"),
        F.when(mapped, match_type_or_default()).otherwise(dash).alias("Type"),
        F.when(mapped, percent).otherwise(dash).alias("Confidence"),
        rule_or(F.when(mapped, F.lit("direct")).otherwise(dash)).alias("Transformation"),
        review_status(mapped).alias("Status"),
        F.coalesce("reasoning", F.lit("")).alias("Reasoning"),
    )


def number_text(c: Column) -> Column:
    """Shortest decimal text, without a fraction for whole numbers."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def sql_statements(items: DataFrame) -> DataFrame:
    """A comment and a SELECT per item."""
    sources = F.array_join("source_columns", ", ")
    text = F.concat(
        F.format_string("-- %s -> %s (%s, ", sources, "target_column", "match_type"),
        number_text(F.col("confidence_score")),
        F.lit("%)\nSELECT "),
        rule_or(sources),
        F.lit(" AS "),
        column_part(F.col("target_column")),
        F.lit(";\n"),
    )
    return items.select("request_id", "pos", text.alias("value"))


def table_select_lines(items: DataFrame) -> DataFrame:
    """One runnable SELECT per target table, as ordered lines, from the table its sources name.

    Lines stay rows, so a table of any width needs no gathering; a table fed by several source tables lists all of
    them and needs its join condition from the caller.
    """
    keys = ["request_id", "target_table"]
    mapped = items.filter(is_mapped(F.col("source_columns"))).withColumn("target_table", table_part(F.col("target_column")))
    firsts = mapped.groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    lead = F.when(F.col("pos") == F.col("first_pos"), "SELECT ").otherwise("     , ")
    columns = mapped.join(firsts, keys).select(
        *keys,
        F.lit(0).alias("block"),
        F.col("pos").cast("string").alias("name"),
        "pos",
        F.concat(lead, rule_or(F.array_join("source_columns", ", ")), F.lit(" AS "), column_part(F.col("target_column"))).alias("value"),
    )
    sources = mapped.select(*keys, F.explode("source_columns").alias("source"))
    tables = sources.select(*keys, table_part(F.col("source")).alias("name")).distinct()
    heads = tables.groupBy(*keys).agg(F.min("name").alias("first_name"))
    froms = tables.join(heads, keys).select(
        *keys,
        F.lit(1).alias("block"),
        "name",
        F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.when(F.col("name") == F.col("first_name"), "FROM ").otherwise("   , "), F.col("name")).alias("value"),
    )
    return columns.unionByName(froms)


SCRIPT_HEAD = "from pyspark.sql import functions as F\n\ndf_result = (\n    df_source"
SCRIPT_TAIL = ")"


def _python_text(c: Column) -> Column:
    """Body of a double-quoted Python string."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def script_lines(items: DataFrame) -> DataFrame:
    """One DataFrame call per item: a rule, in Spark's spelling, becomes withColumn, a copy renames its first source.

    The lines belong between SCRIPT_HEAD and SCRIPT_TAIL.
    """
    target = column_part(F.col("target_column"))
    first = F.coalesce(F.nullif(column_part(F.try_element_at("source_columns", F.lit(1))), F.lit("")), target)
    rule = spark_spelling(F.nullif("transformation_rule", F.lit("")))
    call = F.when(
        rule.isNotNull(), F.format_string('    .withColumn("%s", F.expr("%s"))', _python_text(target), _python_text(rule))
    ).otherwise(F.format_string('    .withColumnRenamed("%s", "%s")', _python_text(first), _python_text(target)))
    return items.select("request_id", "pos", call.alias("value"))


def report_tables(rows: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report: cards, one line per target table, details, and unmapped columns of both sides."""
    sources = results.select("request_id", F.explode("unmapped_source_columns").alias("column_name"))
    targets = unmapped_targets(rows, results).withColumnRenamed("target_column", "column_name")
    return {
        "cards": summary_cards(rows),
        "tables": table_report(rows),
        "details": detail_rows(rows),
        "unmapped": sources.withColumn("side", F.lit("source")).unionByName(targets.withColumn("side", F.lit("target"))),
    }


def session_payloads(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Encode structured session columns as the JSON text the session table stores; null lists become empty ones.

    `columns` maps a structured column to its text column; the current mapping stays null where it is null.
    """
    for name, text in columns.items():
        encoded = F.to_json(F.col(name), KEEP_NULLS)
        df = df.withColumn(text, encoded if text == "current_mapping_json" else F.coalesce(encoded, F.lit("[]")))
    return df.drop(*[c for c in columns if c not in columns.values()])


# --- writers -----------------------------------------------------------------------------------------------------


def write_json(items: DataFrame, path: str) -> None:
    items.select("request_id", *ITEM_FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled in all of them."""
    csv_rows(rows).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_sql(items: DataFrame, path: str) -> None:
    """One folder for each request, its statements in order over its part files."""
    ordered = sql_statements(items).orderBy("request_id", "pos")
    ordered.select("request_id", "value").write.mode("overwrite").partitionBy("request_id").text(path)


def write_script(items: DataFrame, path: str) -> None:
    """The script of one request, in order; its lines are few, one per mapped column."""
    spark = items.sparkSession
    edges = spark.createDataFrame([(-(2**62), SCRIPT_HEAD), (2**62, SCRIPT_TAIL)], "pos bigint, value string")
    lines = script_lines(items).select(F.col("pos").cast("bigint").alias("pos"), "value")
    write_lines(lines.unionByName(edges), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines range-partitioned by position, so that part files follow one another in order."""
    lines.orderBy("pos").select("value").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, results: DataFrame, path: str) -> None:
    for name, table in report_tables(rows, results).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
