"""Strict JSON text: parsed once to VARIANT, null where the text is not exactly one JSON value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one complete JSON value, else null.

    The built-in parser ignores anything after the first value. The text is therefore parsed as the first element of
    an array closed by a hash of that same text; a value that ends early, or is followed by more, cannot leave an
    array of two that ends in the hash.
    """
    mark = F.xxhash64(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = (F.try_variant_get(wrapped, "$[1]", "bigint") == mark) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(whole, F.variant_get(wrapped, "$[0]", "variant"))


def field(v: Column, name: str) -> Column:
    """A field of an object: null where absent, a VARIANT null where the JSON says null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_array(v: Column) -> Column:
    """The elements of a JSON array, null for any other kind."""
    return F.try_variant_get(v, "$", "array<variant>")


# Schema names of the kinds a parsed JSON value can have.
KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
}


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null where the value is absent."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), name)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "object", F.lit(False))


def fits(v: Column, data_type: T.DataType) -> Column:
    """Whether a JSON value has the kinds of a schema all the way down. Absent and null values fit any type."""
    if isinstance(data_type, T.StructType):
        inner = reduce(lambda a, b: a & b, [fits(field(v, f.name), f.dataType) for f in data_type.fields])
        right = (kind(v) == "object") & inner
    elif isinstance(data_type, T.ArrayType):
        right = F.coalesce(F.forall(as_array(v), lambda e: fits(e, data_type.elementType)), F.lit(False))
    else:
        right = kind(v) == ("string" if isinstance(data_type, T.StringType) else "number")
    return F.coalesce(kind(v) == "null", F.lit(True)) | F.coalesce(right, F.lit(False))


def text_value(v: Column) -> Column:
    """String content of a JSON string, null for absent and JSON null."""
    return F.try_variant_get(v, "$", "string")


# Text of a JSON value in pieces: strings, structural characters, and runs of anything else.
TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{},]|[^"\[\]{},]++'
JSON_SPACE = " \t\n\r"


def element_spans(text: Column, most: int) -> Column:
    """(first, after): 1-based positions around the first elements of a valid JSON array, at most so many.

    The text is scanned by position and depth; nothing is parsed or written anew.
    """
    spans = F.array().cast("array<struct<first:int,after:int>>")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), spans.alias("spans"))

    def step(state: Column, token: Column) -> Column:
        at, depth = state["at"], state["depth"]
        after = at + F.char_length(token)
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        ends = (depth == 1) & (F.size(state["spans"]) < most) & token.isin(",", "]")
        found = F.array(F.struct(state["first"].alias("first"), at.alias("after")))
        return F.struct(
            after.alias("at"),
            (depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when((depth == 0) & opens | ends, after).otherwise(state["first"]).alias("first"),
            F.when(ends, F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), start, step, lambda state: state["spans"])


def raw_elements(text: Column, spans: Column) -> Column:
    """The text of the elements exactly as written, without the space around them."""
    return F.transform(spans, lambda s: F.btrim(F.substring(text, s["first"], s["after"] - s["first"]), F.lit(JSON_SPACE)))
