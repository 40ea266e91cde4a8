"""Mapping table: merging duplicates, review rows, reports and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.confidence import (
    column_part,
    confidence_band,
    confidence_percent,
    is_mapped,
    round_half_up,
    source_table,
    table_part,
)
from colweave.schemas import RULE_KEYWORDS

KEY = ("request_id", "target_column")
PLACES = 1_000_000_000  # more than the sources one item can list


def merge_duplicates(items: DataFrame) -> DataFrame:
    """One row per (request, target).

    Sources are the distinct union in order of first appearance, confidence the maximum, match type and reasoning the
    last ones given, the rule the last one that is not null. A target seen once keeps its source list as it is.

    A popular target is first reduced to one row per distinct source, combined on the map side, so what is gathered is
    what ends up in the result, however many items the target has. Sources and the other facts are aggregated apart:
    the first needs only numbers in its buffers, the second does not have to read a row per source.
    """
    # Place of a source: item first, then place within the item, as one number.
    place = F.col("pos").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(10,0)") + F.col("at")
    sources = (
        items.select(*KEY, "pos", F.posexplode("source_columns").alias("at", "source"))
        .groupBy(*KEY, "source")
        .agg(F.min(place).alias("place"))
        .groupBy(*KEY)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda s: s["source"]).alias("union"))
    )
    facts = items.groupBy(*KEY).agg(
        F.min(F.struct("pos", "source_columns")).alias("first"),
        F.max(F.struct("pos", "match_type", "reasoning")).alias("last"),
        F.max(F.when(F.col("transformation_rule").isNotNull(), F.struct("pos", "transformation_rule"))).alias("last_rule"),
        F.max("confidence_score").alias("confidence_score"),
    )
    seen_once = F.col("first.pos") == F.col("last.pos")
    union = F.coalesce("union", F.array().cast("array<string>"))
    return facts.join(sources, [*KEY], "left").select(
        *KEY,
        F.when(seen_once, F.col("first.source_columns")).otherwise(union).alias("source_columns"),
        "confidence_score",
        F.col("last.match_type").alias("match_type"),
        F.col("last.reasoning").alias("reasoning"),
        F.col("last_rule.transformation_rule").alias("transformation_rule"),
        F.col("first.pos").alias("pos"),
    )


def review_rows(items: DataFrame, results: DataFrame) -> DataFrame:
    """Rows to review: every mapped item with its original, and one empty row per unmapped target."""
    original = F.struct("source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")
    mapped = items.select(
        *KEY, "source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule",
        F.lit("pending").alias("status"), original.alias("original"),
    )
    unmapped = results.select("request_id", F.explode("unmapped_target_columns").alias("target_column")).select(
        *KEY,
        F.array().cast("array<string>").alias("source_columns"),
        F.lit(0.0).alias("confidence_score"),
        F.lit("").alias("match_type"),
        F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("transformation_rule"),
        F.lit("pending").alias("status"),
    )
    return mapped.unionByName(unmapped, allowMissingColumns=True)


def unmapped_only(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_mapped(F.col("source_columns")))


def _mapped() -> Column:
    return is_mapped(F.col("source_columns"))


def _mean_percent() -> Column:
    """Mean percent over mapped rows, from an integer sum so that the order of addition cannot matter; 0 where none."""
    total = F.sum(F.when(_mapped(), confidence_percent(F.col("confidence_score"))))
    return F.coalesce(total / F.count_if(_mapped()), F.lit(0.0))


def table_report(rows: DataFrame) -> DataFrame:
    """Mapped, unmapped, total and mean confidence of every target table."""
    return (
        rows.groupBy("request_id", table_part(F.col("target_column")).alias("target_table"))
        .agg(
            F.count_if(_mapped()).alias("n_mapped"),
            F.count_if(~_mapped()).alias("n_unmapped"),
            F.count("*").alias("n_total"),
            _mean_percent().alias("_mean"),
        )
        .withColumn("mean_percent", round_half_up(F.col("_mean")))
        .withColumn("band", confidence_band(F.col("_mean")))
        .drop("_mean")
    )


def source_tables(rows: DataFrame) -> DataFrame:
    """Distinct (target table, source table) pairs of mapped rows."""
    pairs = rows.filter(_mapped()).select(
        "request_id",
        table_part(F.col("target_column")).alias("target_table"),
        F.explode("source_columns").alias("source"),
    ).select("request_id", "target_table", source_table(F.col("source")).alias("source_table"))
    return pairs.filter(F.col("source_table").isNotNull()).distinct()


def table_report_with_sources(rows: DataFrame) -> DataFrame:
    """Table report with the sorted source tables of each target table.

    Pairs are made distinct before they are gathered, so a group holds table names, not rows.
    """
    keys = ["request_id", "target_table"]
    gathered = source_tables(rows).groupBy(*keys).agg(F.array_sort(F.collect_list("source_table")).alias("source_tables"))
    return table_report(rows).join(gathered, keys, "left").withColumn(
        "source_tables", F.coalesce("source_tables", F.array().cast("array<string>"))
    )


def summary_cards(rows: DataFrame) -> DataFrame:
    """Whole-mapping figures per request."""
    return rows.groupBy("request_id").agg(
        F.count_if(_mapped()).alias("n_mapped"),
        F.count_if(~_mapped()).alias("n_unmapped"),
        round_half_up(_mean_percent()).alias("mean_percent"),
    )


def unmapped_targets(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct targets reported unmapped or left without a source."""
    reported = results.select("request_id", F.explode("unmapped_target_columns").alias("target_column"))
    return reported.union(unmapped_only(rows).select(*KEY)).distinct()


def unmapped_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("request_id").agg(F.count_if(~_mapped()).alias("n_unmapped"))


def rule_lineage(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue columns a transformation rule refers to.

    Words outside quoted literals are matched in any case, with or without their leading table part. `catalog` holds
    request_id and qualified. Words are made distinct per item before the join.
    """
    bare = F.regexp_replace("transformation_rule", "'[^']*'", " ")
    word = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"\b[\w.]+\b"), F.lit(0)), F.lower)))
    words = items.filter(F.col("transformation_rule").isNotNull()).select(*KEY, word.alias("word"))
    words = words.filter(~F.upper("word").isin(*RULE_KEYWORDS))
    # Either the word itself or the word without its first part names the column.
    words = words.select(*KEY, F.explode(F.array_distinct(F.array("word", F.regexp_replace("word", r"^\w+\.", "")))).alias("name"))
    columns = catalog.select("request_id", F.lower("qualified").alias("name"), "qualified").distinct()
    return words.join(columns, ["request_id", "name"]).select(*KEY, F.col("qualified").alias("source_column")).distinct()


def detail_rows(rows: DataFrame) -> DataFrame:
    """Detail table of the report: one line per row, as it is shown."""
    mapped = _mapped()
    dash = F.lit("—")
    return rows.select(
        "request_id",
        table_part(F.col("target_column")).alias("target_table"),
        F.when(mapped, F.array_join("source_columns", ", ")).otherwise(dash).alias("source"),
        column_part(F.col("target_column")).alias("target"),
        F.when(mapped, match_type_or_default()).otherwise(dash).alias("match_type"),
        F.when(mapped, F.concat(confidence_percent(F.col("confidence_score")).cast("string"), F.lit("%"))).otherwise(dash).alias("confidence"),
        F.when(mapped, rule_or(F.lit("direct"))).otherwise(dash).alias("rule"),
        review_status(mapped).alias("status"),
        F.when(mapped, F.nullif(F.trim(F.coalesce("reasoning", F.lit(""))), F.lit(""))).alias("reasoning"),
    )


def match_type_or_default() -> Column:
    return F.coalesce(F.nullif("match_type", F.lit("")), F.lit("semantic"))


def rule_or(default: Column) -> Column:
    return F.coalesce(F.nullif("transformation_rule", F.lit("")), default)


def review_status(mapped: Column) -> Column:
    return F.when(~mapped, "Unmapped").when(F.col("status") == "validated", "Validated").otherwise("Pending")
