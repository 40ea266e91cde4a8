"""Budgeted reduction of raw files.

A file is one row and is reduced inside that row, so nothing here shuffles. Line arrays and header facts are staged in
their own projections: they feed several branches, and a staged column is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.delimited import (
    essential_positions,
    looks_like_dictionary,
    non_blank_lines,
    presence_delimiter,
    split_plain,
)
from colweave.functions.json_text import as_array, element_spans, raw_elements, strict_json
from colweave.functions.staging import stage
from colweave.functions.text import file_extension, numbered_note, trim_ws, utf16_length
from colweave.schemas import ESSENTIAL_KEYWORDS, LONG_CELL, REDUCTION_LEVELS, REDUCTION_LIMITS

MOST_OBJECTS = max(limits[1] for limits in REDUCTION_LIMITS.values())
FEWEST_OBJECTS = min(limits[1] for limits in REDUCTION_LIMITS.values())
STAGED = ("_ext", "_lines", "_total", "_is_dict", "_delim", "_cells", "_keep", "_objects", "_total_objects", "_plain")


def stage_files(files: DataFrame) -> DataFrame:
    """Add the facts every level needs: lines of delimited files, dictionary header, JSON elements, plain lines."""
    tabular = F.col("_ext").isin("csv", "tsv", "txt")
    content = F.col("content")
    staged = stage(
        files.withColumn("_ext", file_extension(F.col("file_name"))),
        {
            "_lines": F.when(tabular, non_blank_lines(content)),
            "_total_objects": F.when(F.col("_ext") == "json", F.size(as_array(strict_json(content)))),
        },
    )
    header = F.try_element_at("_lines", F.lit(1))
    staged = stage(
        staged,
        {
            "_plain": F.when(~tabular, F.split(content, "\n")),
            "_objects": F.when(F.col("_total_objects") > FEWEST_OBJECTS, raw_elements(content, element_spans(content, MOST_OBJECTS))),
            "_is_dict": tabular & F.coalesce(looks_like_dictionary(header), F.lit(False)),
        },
    )
    is_dict = F.col("_is_dict")
    staged = staged.withColumn("_total", F.size("_lines")).withColumn("_delim", F.when(is_dict, presence_delimiter(header)))
    cells = F.transform(split_plain(header, F.col("_delim")), lambda h: F.lower(trim_ws(h)))
    staged = stage(staged, {"_cells": F.when(is_dict, cells)})
    return stage(staged, {"_keep": essential_positions(F.col("_cells"), ESSENTIAL_KEYWORDS)})


# Cells are joined on a line break, which no cell can hold, and the break is then turned into the file's delimiter:
# array_join takes a literal separator only.
CELL_BREAK = "\n"


def _join_cells(cells: Column) -> Column:
    return F.replace(F.array_join(cells, CELL_BREAK), F.lit(CELL_BREAK), F.col("_delim"))


def _pruned_dictionary() -> Column:
    """Only the essential columns of every row, missing cells empty."""

    def prune(line: Column) -> Column:
        cells = split_plain(line, F.col("_delim"))
        return _join_cells(F.transform("_keep", lambda i: F.coalesce(trim_ws(F.try_element_at(cells, i + 1)), F.lit(""))))

    note = numbered_note("\n(compressed: kept %d of %d columns)", F.size("_keep"), F.size("_cells"))
    return F.concat(F.array_join(F.transform("_lines", prune), "\n"), note)


def _shortened_dictionary() -> Column:
    """Every row, with cells over the limit cut and marked."""

    def shorten(line: Column) -> Column:
        cells = split_plain(line, F.col("_delim"))
        cut = lambda c: F.concat(F.left(c, F.lit(LONG_CELL)), F.lit("..."))
        return _join_cells(F.transform(cells, lambda c: F.when(utf16_length(c) > LONG_CELL, cut(c)).otherwise(c)))

    return F.array_join(F.transform("_lines", shorten), "\n")


def reduced_content(level: str) -> Column:
    """Content of a staged file at one level."""
    rows, objects, text_lines = REDUCTION_LIMITS[level]
    content = F.col("content")

    head = F.concat(
        F.array_join(F.slice("_lines", 1, rows), "\n"),
        numbered_note("\n... (%d more data rows, %d total)", F.col("_total") - rows, F.col("_total")),
    )
    if level == "light":
        dictionary = content
    elif level == "heavy":
        dictionary = F.when(F.size("_keep") >= 2, _pruned_dictionary()).otherwise(_shortened_dictionary())
    else:
        dictionary = _shortened_dictionary()
    delimited = (
        F.when(F.col("_total") <= rows, content).when(F.col("_is_dict"), dictionary).otherwise(head)
    )

    n_objects = F.col("_total_objects")
    json_array = F.concat(
        F.lit("[\n"),
        F.array_join(F.slice("_objects", 1, objects), ",\n"),
        F.lit("\n]"),
        numbered_note("\n// ... (%d more objects, %d total)", n_objects - objects, n_objects),
    )

    # A short array is still subject to the line limit.
    plain = F.col("_plain")
    truncated = F.concat(
        F.array_join(F.slice(plain, 1, text_lines), "\n"),
        numbered_note("\n... (truncated from %d lines)", F.size(plain)),
    )
    text = F.when(F.size(plain) > text_lines, truncated).otherwise(content)
    return F.when(F.col("_lines").isNotNull(), delimited).when(n_objects > objects, json_array).otherwise(text)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)


def _digits(n: Column) -> Column:
    return F.char_length(n.cast("string"))


def _joined(lengths: Column, separator: int) -> Column:
    """Length of texts of these lengths joined by a separator of that length."""
    return _sum(lengths) + separator * F.greatest(F.size(lengths) - 1, F.lit(0))


def stage_lengths(staged: DataFrame) -> DataFrame:
    """Add the lengths from which those of all levels follow: of lines, JSON elements, and cells of dictionaries.

    Of a dictionary's lines, `_cut_lengths` counts cells cut at the limit, `_kept_lengths` the essential cells.
    """
    lengths = lambda name: F.transform(name, utf16_length)
    is_dict = F.col("_is_dict")

    def cut(line: Column) -> Column:
        cells = split_plain(line, F.col("_delim"))
        of = lambda c: F.when(utf16_length(c) > LONG_CELL, utf16_length(F.left(c, F.lit(LONG_CELL))) + 3).otherwise(utf16_length(c))
        return _joined(F.transform(cells, of), 1)

    def kept(line: Column) -> Column:
        cells = split_plain(line, F.col("_delim"))
        return _joined(F.transform("_keep", lambda i: F.coalesce(utf16_length(trim_ws(F.try_element_at(cells, i + 1))), F.lit(0))), 1)

    return stage(
        staged,
        {
            "_line_lengths": F.coalesce(lengths("_lines"), lengths("_plain")),
            "_object_lengths": lengths("_objects"),
            "_cut_lengths": F.when(is_dict, F.transform("_lines", cut)),
            "_kept_lengths": F.when(is_dict & (F.size("_keep") >= 2), F.transform("_lines", kept)),
            "_length": utf16_length(F.col("content")).cast("bigint"),
        },
    )


def reduced_length(level: str) -> Column:
    """UTF-16 length of `reduced_content` at a level, by arithmetic on staged lengths."""
    rows, objects, text_lines = REDUCTION_LIMITS[level]
    length, lines, total = F.col("_length"), F.col("_line_lengths"), F.col("_total")
    more = lambda n, kept: _digits(n - kept) + _digits(n)
    head = _joined(F.slice(lines, 1, rows), 1) + more(total, rows) + len("\n... ( more data rows,  total)")
    pruned = _joined(F.col("_kept_lengths"), 1) + _digits(F.size("_keep")) + _digits(F.size("_cells")) + len("\n(compressed: kept  of  columns)")
    shortened = _joined(F.col("_cut_lengths"), 1)
    dictionary = {"light": length, "medium": shortened, "heavy": F.coalesce(pruned, shortened)}[level]
    delimited = F.when(total <= rows, length).when(F.col("_is_dict"), dictionary).otherwise(head)
    n_objects = F.col("_total_objects")
    json_array = _joined(F.slice("_object_lengths", 1, objects), 2) + more(n_objects, objects) + len("[\n\n]\n// ... ( more objects,  total)")
    truncated = _joined(F.slice(lines, 1, text_lines), 1) + _digits(F.size(lines)) + len("\n... (truncated from  lines)")
    text = F.when(F.size(lines) > text_lines, truncated).otherwise(length)
    return F.when(F.col("_lines").isNotNull(), delimited).when(n_objects > objects, json_array).otherwise(text)


def reduce_files(files: DataFrame, level: str) -> DataFrame:
    """Every file at one level; columns other than the content are kept."""
    return stage_files(files).withColumn("content", reduced_content(level)).drop(*STAGED)


def file_lengths(files: DataFrame) -> DataFrame:
    """UTF-16 length of every file as it is and at each level, from one pass over the content; no reduced text is made."""
    staged = stage_lengths(stage_files(files))
    lengths = [F.col("_length").alias("len_raw"), *[reduced_length(level).alias(f"len_{level}") for level in REDUCTION_LEVELS]]
    keys = [c for c in files.columns if c != "content"]
    return staged.select(*keys, *lengths, F.octet_length("content").alias("n_bytes"))


def reduce_to_tier(files: DataFrame) -> DataFrame:
    """Content at the tier named in the `tier` column; only that branch is evaluated."""
    staged = stage_files(files)
    chosen = F.col("content")
    for level in REDUCTION_LEVELS:
        chosen = F.when(F.col("tier") == level, reduced_content(level)).otherwise(chosen)
    return staged.withColumn("content", chosen).drop(*STAGED)
