"""Normalisation of mapping replies: text with JSON somewhere inside becomes a clean mapping table.

A reply is one row and is parsed, checked, cleaned and merged inside that row, so a batch of any size runs without a
shuffle and no reply depends on another. A reply that cannot be read gets an `error` and no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.json_text import as_array, field, is_object, kind, strict_json, text_value
from colweave.functions.staging import stage
from colweave.functions.text import is_blank, last_position, trim_ws
from colweave.schemas import DEFAULT_MATCH_TYPE, DEFAULT_REFINE_MESSAGE, MATCH_TYPES

# Fixed patterns: the fenced block, and the one kind of trailing comma that is repaired.
FENCE = r"(?U)```(?:json)?\s*([\s\S]*?)```"
COMMA_BEFORE_BRACE = r"(?U),\s*\}"

STRINGS = "array<string>"
NAME_LISTS = ("ARRAY<STRING>", "ARRAY<VOID>")


def extract_json(reply: Column) -> Column:
    """JSON text of a reply: the first fenced block as it is, else the outermost braces with trailing commas removed.

    Null where the reply holds neither.
    """
    fenced = F.when(F.regexp_extract(reply, FENCE, 0) != "", trim_ws(F.regexp_extract(reply, FENCE, 1)))
    start, end = F.locate("{", reply), last_position(reply, "}")
    braces = F.when((start > 0) & (end > start), F.substring(reply, start, end - start + 1))
    cleaned = F.replace(F.regexp_replace(braces, COMMA_BEFORE_BRACE, "}"), F.lit(", ]"), F.lit("]"))
    return F.coalesce(fenced, cleaned)


def _cell(row: Column, name: str) -> Column:
    """Kind and text of a field; the kind is null where the field is absent."""
    value = field(row, name)
    return F.struct(kind(value).alias("kind"), text_value(value).alias("text"))


def _number(row: Column, name: str) -> Column:
    value = field(row, name)
    return F.struct(kind(value).alias("kind"), F.try_variant_get(value, "$", "double").alias("value"))


def _names(row: Column, name: str) -> Column:
    """A list of names; `ok` is false for anything but an array of strings and nulls."""
    value = field(row, name)
    return F.struct(
        value.isNotNull().alias("present"),
        F.coalesce(F.schema_of_variant(value).isin(*NAME_LISTS), value.isNull()).alias("ok"),
        F.filter(
            F.coalesce(F.try_variant_get(value, "$", STRINGS), F.array().cast(STRINGS)), lambda s: F.coalesce(s != "", F.lit(False))
        ).alias("names"),
    )


def _text_ok(cell: Column) -> Column:
    return cell["kind"].isNull() | cell["kind"].isin("string", "null")


def _number_ok(cell: Column) -> Column:
    return cell["kind"].isNull() | (cell["kind"] == "number")


def _first_present(a: Column, b: Column) -> Column:
    """The first field if it is present at all, even as null; else its alias."""
    return F.when(a["kind"].isNotNull(), a).otherwise(b)


def _read_item(row: Column) -> Column:
    """All fields of an item that matter, read once."""
    return F.struct(
        kind(row).alias("kind"),
        _cell(row, "target_table").alias("target_table"),
        _cell(row, "source_table").alias("source_table"),
        _first_present(_cell(row, "target_column"), _cell(row, "target")).alias("target"),
        _names(row, "source_columns").alias("sources"),
        _first_present(_cell(row, "source_column"), _cell(row, "source")).alias("single_source"),
        _first_present(_cell(row, "transformation_rule"), _cell(row, "transformation")).alias("rule"),
        _first_present(_cell(row, "reasoning"), _cell(row, "reason")).alias("reasoning"),
        _cell(row, "match_type").alias("match_type"),
        _first_present(_number(row, "confidence_score"), _number(row, "confidence")).alias("confidence"),
    )


def _qualified(name: Column, table: Column) -> Column:
    """Name with its table in front, unless it is qualified already or no table is given."""
    plain = F.contains(name, F.lit(".")) | (F.coalesce(table, F.lit("")) == "")
    return F.when(plain, name).otherwise(F.concat(table, F.lit("."), name))


def _clean_item(aliases: bool):
    def clean(r: Column) -> Column:
        has_target = F.coalesce(r["target"]["text"] != "", F.lit(False))
        sources = r["sources"]["names"]
        if aliases:
            single = F.when(r["single_source"]["kind"].isNotNull(), F.array(F.coalesce(r["single_source"]["text"], F.lit(""))))
            sources = F.when(r["sources"]["present"], sources).otherwise(F.coalesce(single, sources))
        # Fields behind a missing target are never looked at, so they cannot spoil the reply.
        readable = (
            (F.coalesce(r["kind"], F.lit("")) == "object")
            & _text_ok(r["target_table"])
            & _text_ok(r["source_table"])
            & _text_ok(r["target"])
            & (
                ~has_target
                | (
                    r["sources"]["ok"]
                    & _text_ok(r["rule"])
                    & _text_ok(r["reasoning"])
                    & _text_ok(r["match_type"])
                    & _number_ok(r["confidence"])
                )
            )
        )
        match_type = r["match_type"]["text"]
        return F.struct(
            readable.alias("readable"),
            F.when(has_target, _qualified(r["target"]["text"], r["target_table"]["text"])).alias("target_column"),
            F.transform(sources, lambda s: _qualified(s, r["source_table"]["text"])).alias("source_columns"),
            F.coalesce(r["confidence"]["value"], F.lit(0.0)).alias("confidence_score"),
            F.when(match_type.isin(*MATCH_TYPES), match_type).otherwise(DEFAULT_MATCH_TYPE).alias("match_type"),
            F.coalesce(r["reasoning"]["text"], F.lit("")).alias("reasoning"),
            r["rule"]["text"].alias("transformation_rule"),
        )

    return clean


def _merge_group(g: Column) -> Column:
    """Items of one target, in order of appearance, as one item."""
    last = F.element_at(g, -1)
    merged = F.struct(
        last["target_column"].alias("target_column"),
        F.array_distinct(F.flatten(g["source_columns"])).alias("source_columns"),
        F.array_max(g["confidence_score"]).alias("confidence_score"),
        last["match_type"].alias("match_type"),
        last["reasoning"].alias("reasoning"),
        F.try_element_at(F.filter(g["transformation_rule"], lambda x: x.isNotNull()), F.lit(-1)).alias("transformation_rule"),
    )
    return F.when(F.size(g) == 1, last).otherwise(merged)


def merge_items(items: Column) -> Column:
    """Items with one entry per target, in order of first appearance. Lists without duplicates pass through.

    Items are sorted by target and cut where the target changes, so a long reply costs its sorting.
    """
    targets = F.array_distinct(F.transform(items, lambda i: i["target_column"]))
    keyed = F.array_sort(F.transform(items, lambda i, at: F.struct(i["target_column"].alias("target"), at.alias("at"), i.alias("item"))))
    # One-element arrays bind a value once; inside a lambda it would be computed for every element.
    merged = F.transform(F.array(keyed), _merge_sorted)[0]
    return F.when(F.size(targets) == F.size(items), items).otherwise(merged)


def _merge_sorted(keyed: Column) -> Column:
    changed = lambda s: (s == 1) | (F.element_at(keyed, s)["target"] != F.element_at(keyed, F.greatest(s - 1, F.lit(1)))["target"])
    starts = F.filter(F.sequence(F.lit(1), F.size(keyed)), changed)

    def cut(begins: Column) -> Column:
        return F.transform(begins, lambda s, i: F.slice(keyed, s, F.coalesce(F.get(begins, i + 1), F.size(keyed) + 1) - s))

    groups = F.transform(F.array(starts), cut)[0]
    merged = F.transform(groups, lambda g: F.struct(g[0]["at"].alias("at"), _merge_group(F.transform(g, lambda x: x["item"])).alias("item")))
    return F.transform(F.array_sort(merged), lambda m: m["item"])


def normalize_replies(replies: DataFrame, envelope: bool = False, aliases: bool = False) -> DataFrame:
    """One row per reply: items, unmapped lists, confidence, summary, and an error where the reply is unusable.

    `envelope` reads refine replies, which wrap the mapping and carry a message. `aliases` also accepts a single
    `source_column` or `source`; it is off by default, which leaves such items without a source.
    """
    reply = F.col("reply_text")
    staged = stage(replies, {"_json": F.when(~is_blank(reply), extract_json(reply))})
    staged = stage(staged, {"_doc": strict_json(F.col("_json"))})
    doc, root = F.col("_doc"), F.col("_root")
    if envelope:
        staged = stage(
            staged,
            {
                "_root": F.when(is_object(doc), F.coalesce(field(doc, "mapping"), doc)),
                "_message": F.when(is_object(doc), _cell(doc, "message")),
            },
        )
    else:
        staged = staged.withColumn("_root", doc)
    staged = stage(
        staged,
        {
            "_is_object": is_object(root),
            "_list": F.when(is_object(root), F.coalesce(field(root, "mappings"), field(root, "mapping"))),
            "_source": _names(root, "unmapped_source_columns"),
            "_target": _names(root, "unmapped_target_columns"),
            "_given": _number(root, "global_confidence"),
            "_summary": _cell(root, "analysis_summary"),
        },
    )
    staged = stage(staged, {"_read": F.transform(as_array(F.col("_list")), _read_item)})
    staged = stage(staged, {"_clean": F.coalesce(F.transform("_read", _clean_item(aliases)), F.array())})
    fields_ok = (
        (F.col("_list").isNull() | (kind(F.col("_list")) == "array"))
        & F.forall("_clean", lambda i: i["readable"])
        & F.col("_source.ok")
        & F.col("_target.ok")
        & _number_ok(F.col("_given"))
        & _text_ok(F.col("_summary"))
    )
    if envelope:
        fields_ok = fields_ok & _text_ok(F.col("_message"))
    error = (
        F.when(is_blank(reply), "empty reply")
        .when(F.col("_json").isNull(), "no JSON in reply")
        .when(doc.isNull(), "invalid JSON")
        .when(~F.col("_is_object"), "mapping is not an object")
        .when(~fields_ok, "unexpected kind of value")
    )
    keep = [c for c in replies.columns if c != "reply_text"]
    named = F.filter("_clean", lambda i: i["target_column"].isNotNull())
    items = F.transform(
        named,
        lambda i: F.struct(
            *[
                i[n].alias(n)
                for n in ("target_column", "source_columns", "confidence_score", "match_type", "reasoning", "transformation_rule")
            ]
        ),
    )
    staged = stage(staged, {"error": error})
    staged = stage(staged, {"_items": F.when(F.col("error").isNull(), items)})
    staged = stage(staged, {"mappings": merge_items(F.col("_items"))})
    ok = F.col("error").isNull()
    total = F.aggregate("mappings", F.lit(0.0), lambda acc, i: acc + i["confidence_score"])
    mean = F.coalesce(F.try_divide(total, F.size("mappings")), F.lit(0.0))
    output = [
        "mappings",
        F.when(ok, F.col("_source.names")).alias("unmapped_source_columns"),
        F.when(ok, F.col("_target.names")).alias("unmapped_target_columns"),
        F.when(ok, F.coalesce(F.col("_given.value"), mean)).alias("global_confidence"),
        F.when(ok, F.coalesce(F.col("_summary.text"), F.lit(""))).alias("analysis_summary"),
        "error",
    ]
    if envelope:
        output.append(F.when(ok, F.coalesce(F.col("_message.text"), F.lit(DEFAULT_REFINE_MESSAGE))).alias("message"))
    return staged.select(*keep, *output)


def reply_items(normalized: DataFrame) -> DataFrame:
    """Mapping-items table of normalised replies, with the position of each item."""
    rows = normalized.filter(F.col("error").isNull()).select("request_id", F.posexplode("mappings").alias("pos", "item"))
    return rows.select("request_id", "item.*", F.col("pos").cast("bigint").alias("pos"))


def reply_results(normalized: DataFrame) -> DataFrame:
    return normalized.drop("mappings")


def reply_errors(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("error").isNotNull()).select("request_id", "error")
