"""Table schemas and the fixed values the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_FILE = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("pos", T.LongType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
    ]
)

MAPPING_ITEM = T.StructType(
    [
        T.StructField("target_column", T.StringType(), False),
        T.StructField("source_columns", T.ArrayType(T.StringType())),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("transformation_rule", T.StringType()),
    ]
)

MAPPING_RESULT = T.StructType(
    [
        T.StructField("mappings", T.ArrayType(MAPPING_ITEM)),
        T.StructField("unmapped_source_columns", T.ArrayType(T.StringType())),
        T.StructField("unmapped_target_columns", T.ArrayType(T.StringType())),
        T.StructField("global_confidence", T.DoubleType()),
        T.StructField("analysis_summary", T.StringType()),
    ]
)

# JSON payloads kept in the TEXT columns of a saved session.
SESSION_FILES = T.ArrayType(
    T.StructType([T.StructField("fileName", T.StringType()), T.StructField("content", T.StringType())])
)
SESSION_CHAT = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
SESSION_RULES = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])
)

EDIT_PAYLOAD = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("rule", T.StringType()),
    ]
)

# ---- fixed values: results depend on these exact settings ----

# Reduction limits per level: delimited lines, JSON objects, text lines.
REDUCTION_LIMITS = {
    "light": (21, 5, 500),
    "medium": (6, 2, 100),
    "heavy": (3, 1, 50),
}
REDUCTION_LEVELS = ("light", "medium", "heavy")
TIER_LABELS = {
    "raw": "Tier 1 (raw)",
    "light": "Tier 2 (light)",
    "medium": "Tier 3 (medium)",
    "heavy": "Tier 4 (heavy)",
}

# A first line holding two of these words marks a data dictionary.
DICTIONARY_KEYWORDS = ("table", "column", "field", "type", "schema", "description", "comment", "nullable")
# Header words that keep a dictionary column at the heavy level.
ESSENTIAL_KEYWORDS = ("table", "column", "field", "name", "type", "data_type", "datatype")
LONG_CELL = 50

# Token budget.
CHARS_PER_TOKEN = 4.0
FILE_OVERHEAD_TOKENS = 20
FIXED_OVERHEAD_TOKENS = 200
RESPONSE_BUFFER_TOKENS = 4000
SYSTEM_PROMPT_TOKENS = 609
DEFAULT_TOKEN_LIMIT = 128_000

# Reply contract.
MATCH_TYPES = ("exact", "semantic", "transformed", "derived", "incompatible")
DEFAULT_MATCH_TYPE = "semantic"
DEFAULT_REFINE_MESSAGE = "Mapping updated."

PREVIEW_ROWS = 50
JSON_PROFILE_DEPTH = 20
SUGGESTION_LIMIT = 30

# Words and type names a transformation rule may use.
RULE_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "AS", "CAST", "COALESCE", "CONCAT", "TRIM", "UPPER", "LOWER", "SUBSTRING", "CASE",
    "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "NULL", "IS", "IN", "LIKE", "BETWEEN", "JOIN", "LEFT",
    "RIGHT", "INNER", "ON", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT", "COUNT",
    "SUM", "AVG", "MIN", "MAX", "REPLACE", "CONVERT", "VARCHAR", "INT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE",
    "DECIMAL", "DATE", "DATETIME", "TIMESTAMP", "STRING", "BOOLEAN", "TRUE", "FALSE",
)
