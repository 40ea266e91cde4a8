"""Column catalogue: tables and columns found in raw files.

Every file is one row and is listed inside that row; only the final explode multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.delimited import first_line, header_names, looks_like_dictionary, presence_delimiter, split_plain
from colweave.functions.json_text import as_array, field, is_object, kind, strict_json, text_value
from colweave.functions.staging import written
from colweave.functions.text import base_name, is_blank, null_if_blank, trim_ws

KEYS = ("request_id", "side", "file_name")
ENTRY = "array<struct<table_name:string,column_name:string,data_type:string,nullable:boolean>>"


def _entry(table: Column, column: Column, data_type: Column | None = None, nullable: Column | None = None) -> Column:
    return F.struct(
        table.alias("table_name"),
        column.alias("column_name"),
        (F.lit(None) if data_type is None else data_type).cast("string").alias("data_type"),
        (F.lit(None) if nullable is None else nullable).cast("boolean").alias("nullable"),
    )


def _explode(files: DataFrame, entries: Column) -> DataFrame:
    return files.select(*KEYS, F.posexplode(entries).alias("ordinal", "entry")).select(
        *KEYS, "entry.table_name", "entry.column_name", (F.col("ordinal") + 1).alias("ordinal"), "entry.data_type", "entry.nullable"
    )


def list_columns(files: DataFrame) -> DataFrame:
    """Columns of every file by its form.

    A JSON schema document lists its `columns`; a JSON array of objects lists the keys of its first object in
    document order; other valid JSON lists nothing; anything else lists the cells of its first line, split on any of
    the four delimiters.
    """
    return _explode(*_listed(files))


def _listed(files: DataFrame) -> tuple[DataFrame, Column]:
    """Files with staged columns, and the entries they list by their form."""
    staged = (
        files.withColumn("_doc", strict_json(F.col("content")))
        .withColumn("_columns", F.when(is_object(F.col("_doc")), field(F.col("_doc"), "columns")))
        .withColumn("_base", base_name(F.col("file_name")))
    )
    doc, columns, base = F.col("_doc"), F.col("_columns"), F.col("_base")

    table = F.coalesce(F.nullif(text_value(field(doc, "table_name")), F.lit("")), base)
    described = F.filter(
        F.transform(
            as_array(columns),
            lambda c: _entry(
                table,
                text_value(field(c, "name")),
                text_value(field(c, "data_type")),
                F.try_variant_get(c, "$.nullable", "boolean"),
            ),
        ),
        lambda e: e["column_name"].isNotNull(),
    )
    keys = F.transform(
        F.json_object_keys(F.get_json_object("content", "$[0]")), lambda k: _entry(base, k)
    )
    headers = F.transform(header_names(first_line(F.col("content"))), lambda h: _entry(base, h))

    columns_kind = kind(columns)
    # false, zero and the empty string count as no `columns` at all.
    empty_value = columns_kind.isNull() | (columns_kind == "null") | text_value(columns).isin("", "0", "false")
    entries = (
        F.when(doc.isNull(), headers)
        .when(columns_kind == "array", described)
        .when(is_object(doc) & ~F.coalesce(empty_value, F.lit(False)), headers)
        .when(kind(doc) == "array", F.coalesce(keys, F.array().cast(ENTRY)))
    )
    return staged, entries.cast(ENTRY)


def list_dictionary_columns(files: DataFrame) -> DataFrame:
    """Columns described by the rows of a data dictionary; cells are picked by their header."""
    staged, entries = _dictionary(files)
    return _explode(staged.filter(looks_like_dictionary(F.col("_header"))), entries)


def _dictionary(files: DataFrame) -> tuple[DataFrame, Column]:
    """Files with staged columns, and the entries that their rows describe if they are dictionaries."""
    lines = F.filter(F.split("content", "\r?\n"), lambda line: ~is_blank(line))
    staged = files.withColumn("_lines", lines).withColumn("_header", F.lower(F.try_element_at("_lines", F.lit(1))))
    staged = staged.withColumn("_delim", presence_delimiter(F.col("_header")))
    staged = staged.withColumn("_names", F.transform(split_plain(F.col("_header"), F.col("_delim")), trim_ws))

    def first_where(test) -> Column:
        """1-based position of the first header that meets a test."""
        flagged = F.transform("_names", lambda h, i: F.when(test(h), i + 1))
        return F.try_element_at(F.filter(flagged, lambda at: at.isNotNull()), F.lit(1))

    def position(*tests) -> Column:
        return F.coalesce(*[first_where(test) for test in tests])

    has = lambda word: lambda h: F.contains(h, F.lit(word))
    staged = staged.select(
        *files.columns,
        "_lines",
        "_header",
        "_delim",
        base_name(F.col("file_name")).alias("_file_base"),
        position(has("table")).alias("_table_at"),
        position(has("column"), has("field"), lambda h: F.contains(h, F.lit("name")) & ~F.contains(h, F.lit("table"))).alias("_column_at"),
        position(has("type")).alias("_type_at"),
        position(has("nullable")).alias("_null_at"),
    )

    def row(line: Column) -> Column:
        cells = split_plain(line, F.col("_delim"))
        at = lambda name: null_if_blank(F.try_element_at(cells, F.col(name)))
        nullable = F.when(F.lower(at("_null_at")).isin("true", "yes", "y", "1"), True).when(
            F.lower(at("_null_at")).isin("false", "no", "n", "0"), False
        )
        return _entry(F.coalesce(at("_table_at"), F.col("_file_base")), at("_column_at"), at("_type_at"), nullable)

    rows = F.transform(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), row)
    return staged, F.filter(rows, lambda e: e["column_name"].isNotNull())


# Fixed formats of free-text schemas: `=== TITLE (table) ===` headings and `name (type, ...)` lines.
HEADING = r"^=+.*\((\w[\w.]*)\)[^()]*=+\s*$"
SECTION_START = r"(?m)^(?==+[^=\n])"
COLUMN_LINE = r"^\s*([A-Za-z_]\w*)\s*\(\s*([A-Za-z]\w*(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?)"


def list_text_columns(files: DataFrame) -> DataFrame:
    """Columns described by free text, one `name (type, ...)` per line under an optional heading per table."""
    return _explode(files, _free_text())


def _free_text() -> Column:
    def columns_of(section: Column) -> Column:
        lines = F.split(section, "\r?\n")
        heading = F.regexp_extract(F.get(lines, F.lit(0)), HEADING, 1)
        table = F.coalesce(F.nullif(heading, F.lit("")), base_name(F.col("file_name")))
        found = F.filter(lines, lambda line: line.rlike(COLUMN_LINE))
        return F.transform(
            found,
            lambda line: _entry(table, F.regexp_extract(line, COLUMN_LINE, 1), F.regexp_extract(line, COLUMN_LINE, 2)),
        )

    return F.flatten(F.transform(F.split("content", SECTION_START), columns_of))


def described_columns(files: DataFrame) -> DataFrame:
    """Catalogue of what files describe: dictionaries row by row, free-text schemas line by line, the rest by form.

    A text file counts as a free-text schema when one of its lines has the form of a column line. All forms are told
    apart and listed in one pass over the files.
    """
    staged, listed = _listed(files)
    staged, described = _dictionary(staged)
    head = F.lower(first_line(F.col("content")))
    is_dictionary = looks_like_dictionary(head) & F.coalesce(head.rlike("[,;\t]"), F.lit(False))
    entries = (
        F.when(F.col("_doc").isNotNull(), listed)
        .when(is_dictionary & looks_like_dictionary(F.col("_header")), described)
        .when(is_dictionary, F.array().cast(ENTRY))
        .when(F.col("content").rlike("(?m)" + COLUMN_LINE), _free_text())
        .otherwise(listed)
    )
    return _explode(staged, entries.cast(ENTRY))


def qualified_names(catalog: DataFrame) -> DataFrame:
    """Catalogue with the `table.column` name used by mappings."""
    return catalog.withColumn("qualified", F.concat_ws(".", "table_name", "column_name"))


def search_columns(catalog: DataFrame, query: str) -> DataFrame:
    """Columns whose qualified name contains the query in any case; a blank query keeps all."""
    named = qualified_names(catalog)
    wanted = query.strip().lower()
    return named.filter(F.contains(F.lower("qualified"), F.lit(wanted))) if wanted else named


GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of a text of the given size; the empty piece for size 0."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))
    return F.when(size == 0, F.array(F.lit(""))).when(F.char_length(text) < size, F.array().cast("array<string>")).otherwise(pieces)


def search_text(query: Column) -> Column:
    """What a search looks for: the query in lower case without outer blanks, empty for none."""
    return F.lower(trim_ws(F.coalesce(query, F.lit(""))))


def search_columns_for(catalog: DataFrame, searches: DataFrame) -> DataFrame:
    """`search_columns` for many searches (search_id, query) at once.

    Distinct names are indexed by their pieces of up to three characters. Each search looks up the rarest piece of its
    query, so a piece that every name has is read only for queries made of such pieces, and its hits are verified. Pieces and
    hits take far more memory than Spark's estimate of them, so they are never broadcast.
    """
    named = qualified_names(catalog).withColumn("lowered", F.lower("qualified"))
    wanted = searches.select("search_id", search_text(F.col("query")).alias("wanted"))
    queries = wanted.select("wanted").distinct()
    pieces = _grams(F.col("wanted"), F.least(F.char_length("wanted"), F.lit(GRAM)))
    asked = queries.select("wanted", F.size(pieces).alias("n_pieces"), F.explode(pieces).alias("gram"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: _grams(F.col("lowered"), n)))
    index = named.select("lowered").distinct().select("lowered", F.explode(every).alias("gram"))
    index = written(index.join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "gram").groupBy("wanted", "n_pieces").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("rarest"))
    rarest = rarest.filter(F.col("found") == F.col("n_pieces")).select("wanted", "rarest.gram")
    hits = rarest.join(index.hint("merge"), "gram").filter(F.contains("lowered", F.col("wanted"))).select("wanted", "lowered")
    return wanted.join(hits.hint("merge"), "wanted").join(named.hint("merge"), "lowered").select("search_id", *[c for c in named.columns if c != "lowered"])
