"""Delimited text held in one string column: delimiters, lines and cells.

Three delimiter rules exist side by side because the three consumers disagree on purpose:
previews vote on the first line, reduction looks for presence, column listing splits on any.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from colweave.functions.text import contains_any, count_of, is_blank, trim_script
from colweave.schemas import DICTIONARY_KEYWORDS

ANY_DELIMITER = "[,;\t|]"


def first_line(content: Column) -> Column:
    """First line of the trimmed text; the rest of the text is not split."""
    return F.split(trim_script(content), "\r?\n", 2)[0]


def non_blank_lines(content: Column, pattern: str = "\n") -> Column:
    return F.filter(F.split(content, pattern), lambda line: ~is_blank(line))


def vote_delimiter(line: Column) -> Column:
    """Most frequent of comma, tab, semicolon and pipe; ties go in that order; comma where none occurs."""
    counts = {d: count_of(line, d) for d in (",", "\t", ";", "|")}
    most = F.greatest(*counts.values())
    return (
        F.when(counts[","] == most, ",")
        .when(counts["\t"] == most, "\t")
        .when(counts[";"] == most, ";")
        .otherwise("|")
    )


def presence_delimiter(line: Column) -> Column:
    """Tab if present, else semicolon if present, else comma."""
    return F.when(F.contains(line, F.lit("\t")), "\t").when(F.contains(line, F.lit(";")), ";").otherwise(",")


def looks_like_dictionary(line: Column) -> Column:
    """At least two of the dictionary keywords occur in the line, in any case."""
    lowered = F.lower(line)
    hits = reduce(add, [F.contains(lowered, F.lit(w)).cast("int") for w in DICTIONARY_KEYWORDS])
    return hits >= 2


def split_plain(line: Column, delimiter: Column) -> Column:
    """Cells without any quote rule. The delimiter is data, so it is quoted for the regular expression."""
    return F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def split_quoted(line: Column, delimiter: Column) -> Column:
    """Cells where a double quote toggles quoting and is dropped, trimmed.

    Pieces between quotes alternate between outside and inside. Quotes are gone after that split, so the quote
    character is free to mark the delimiters that lie outside; no look-ahead is needed and unbalanced quotes
    behave as a toggle.
    """
    pieces = F.split(line, '"')
    marked = F.transform(pieces, lambda s, i: F.when(i % 2 == 0, F.replace(s, delimiter, F.lit('"'))).otherwise(s))
    return F.transform(F.split(F.array_join(marked, ""), '"'), trim_script)


def header_names(line: Column) -> Column:
    """Non-blank trimmed names of a header line split on any delimiter."""
    return F.filter(F.transform(F.split(line, ANY_DELIMITER), trim_script), lambda h: h != "")


def essential_positions(header_cells: Column, words: tuple[str, ...]) -> Column:
    """0-based positions of the header cells that contain one of the words."""
    flagged = F.transform(header_cells, lambda h, i: F.when(contains_any(h, words), i))
    return F.filter(flagged, lambda i: i.isNotNull())
