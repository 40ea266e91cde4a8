"""Engine tables derived from the given tables.

Request ids come from key ranges, so the number of requests grows with the data while a request stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILES_PER_REQUEST = 8
ITEM_REQUESTS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw files: eight to a request, sides alternating, three extensions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ext = F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "csv").otherwise("md")
    return docs.select(
        F.floor(F.col("doc_id") / FILES_PER_REQUEST).cast("string").alias("request_id"),
        F.when(F.col("doc_id") % 2 == 0, "source").otherwise("target").alias("side"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_name"),
        F.col("text").alias("content"),
    )


RAW_FILES_SQL = f"""
raw_files AS (
  SELECT CAST(doc_id // {FILES_PER_REQUEST} AS VARCHAR) AS request_id,
         CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'target' END AS side,
         doc_id AS pos,
         'doc_' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' ELSE 'md' END AS file_name,
         text AS content
  FROM documents
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request, with an instruction on every other one and rules on every third."""
    rid = F.floor(F.col("doc_id") / FILES_PER_REQUEST)
    ids = table(spark, sf_dir, "documents").select(rid.alias("rid")).distinct()
    return ids.select(
        F.col("rid").cast("string").alias("request_id"),
        F.when(F.col("rid") % 2 == 0, F.concat(F.lit("  map request "), F.col("rid").cast("string"))).alias("user_instruction"),
        F.when(F.col("rid") % 3 == 0, F.lit("keep names short\n\nprefer casts ")).when(F.col("rid") % 3 == 1, "  ").alias("rules"),
    )


REQUESTS_SQL = f"""
requests AS (
  SELECT CAST(rid AS VARCHAR) AS request_id,
         CASE WHEN rid % 2 = 0 THEN '  map request ' || rid END AS user_instruction,
         CASE rid % 3 WHEN 0 THEN 'keep names short' || chr(10) || chr(10) || 'prefer casts ' WHEN 1 THEN '  ' END AS rules
  FROM (SELECT DISTINCT doc_id // {FILES_PER_REQUEST} AS rid FROM documents)
)"""


def mapping_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping item per part, in a few requests that name the same targets; many parts share a target, so duplicates merge."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        (F.col("p_partkey") % ITEM_REQUESTS).cast("string").alias("request_id"),
        F.concat_ws(".", "p_brand", F.try_element_at(words, F.lit(2))).alias("target_column"),
        F.array(F.concat_ws(".", words[0], F.col("p_type")), words[0]).alias("source_columns"),
        (F.col("p_size") / F.lit(50.0)).alias("confidence_score"),
        F.when(F.col("p_partkey") % 4 == 0, "exact").otherwise("semantic").alias("match_type"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("part "), F.col("p_partkey").cast("string"))).alias("reasoning"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("upper("), words[0], F.lit(")"))).alias("transformation_rule"),
        F.col("p_partkey").alias("pos"),
    )


MAPPING_ITEMS_SQL = f"""
mapping_items AS (
  SELECT CAST(p_partkey % {ITEM_REQUESTS} AS VARCHAR) AS request_id,
         p_brand || '.' || string_split(p_name, ' ')[2] AS target_column,
         [string_split(p_name, ' ')[1] || '.' || p_type, string_split(p_name, ' ')[1]] AS source_columns,
         p_size / 50.0 AS confidence_score,
         CASE WHEN p_partkey % 4 = 0 THEN 'exact' ELSE 'semantic' END AS match_type,
         CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'part ' || p_partkey END AS reasoning,
         CASE WHEN p_partkey % 3 <> 0 THEN 'upper(' || string_split(p_name, ' ')[1] || ')' END AS transformation_rule,
         p_partkey AS pos
  FROM part
)"""
