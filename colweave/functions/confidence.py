"""Confidence and qualified-name expressions used by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TABLE = "Mappings"


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("bigint")


def confidence_percent(score: Column) -> Column:
    """Scores up to 1 are fractions, larger ones are percentages already."""
    return round_half_up(F.when(score <= 1, score * 100).otherwise(score))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")


def table_part(qualified: Column) -> Column:
    """Everything before the last dot, or the default table name."""
    return F.when(F.contains(qualified, F.lit(".")), F.regexp_replace(qualified, r"\.[^.]*$", "")).otherwise(DEFAULT_TABLE)


def column_part(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def source_table(qualified: Column) -> Column:
    """Text before the first dot, null where there is none or it leads."""
    return F.when(F.locate(".", qualified) > 1, F.substring_index(qualified, ".", 1))


def is_mapped(source_columns: Column) -> Column:
    return F.coalesce(F.size(source_columns) > 0, F.lit(False))
