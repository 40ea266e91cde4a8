"""Text expressions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from colweave.schemas import CHARS_PER_TOKEN

# The Unicode White_Space characters, which trimming strips (plain SQL TRIM strips spaces only).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def trim_script(c: Column) -> Column:
    """Trimming as script code does it: the byte order mark counts as white space, the next-line character does not."""
    return F.btrim(c, F.lit(WHITE_SPACE.replace("\x85", "") + "\ufeff"))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | (trim_ws(c) == "")


def null_if_blank(c: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(trim_ws(c), F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; the encoding step is paid only for text outside ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.char_length(c)).otherwise(
        (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")
    )


def tokens_for_length(length: Column) -> Column:
    return F.ceil(length.cast("double") / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    """Size of a text in tokens: a quarter of its UTF-16 length, rounded up."""
    return tokens_for_length(utf16_length(c))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def count_of(c: Column, piece: str) -> Column:
    """How often a one-character piece occurs."""
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(piece), F.lit("")))


def last_position(c: Column, piece: str) -> Column:
    """1-based position of the last occurrence of a one-character piece, 0 where absent."""
    return F.when(F.contains(c, F.lit(piece)), F.char_length(c) - F.locate(piece, F.reverse(c)) + 1).otherwise(0)


def numbered_note(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def short_user_label(user_id: Column, display_name: Column) -> Column:
    """Display name, else a shortened id for long ids."""
    shortened = F.concat(F.lit("User "), F.left(user_id, F.lit(8)), F.lit("…"))
    return F.when(~is_blank(display_name), trim_ws(display_name)).otherwise(
        F.when(F.char_length(user_id) > 12, shortened).otherwise(user_id)
    )


def iso_timestamp(ts: Column) -> Column:
    """Round-trip text with a seven-digit fraction, e.g. 2024-01-01T00:00:07.1795750."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'")


def session_name(ts: Column) -> Column:
    """Default name of an unnamed session."""
    return F.concat(F.lit("Session "), F.date_format(ts, "yyyy-MM-dd HH:mm"))


def same_text_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
