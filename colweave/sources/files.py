"""Scans of raw files and of the delimited or JSON text inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.functions.delimited import first_line, split_quoted, vote_delimiter
from colweave.functions.json_text import kind, strict_json
from colweave.functions.staging import stage
from colweave.functions.text import file_extension, is_blank, trim_script
from colweave.schemas import JSON_PROFILE_DEPTH, PREVIEW_ROWS

FILE_KEYS = ("request_id", "side", "file_name")


def without_bom(text: Column) -> Column:
    """Text without the byte order mark that some editors put before it."""
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def scan_raw_files(spark: SparkSession, path: str, side: str, request_id: str = "0") -> DataFrame:
    """Whole text of every file below a path, tagged with its side, oldest first. Suits files that fit a row."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(request_id).alias("request_id"),
        F.lit(side).alias("side"),
        F.unix_micros("_metadata.file_modification_time").alias("pos"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        without_bom(F.col("value")).alias("content"),
    )


def scan_file_lines(spark: SparkSession, path: str, side: str, request_id: str = "0") -> DataFrame:
    """One row per line, for files too large to hold in a row: a file is read in splits by many tasks.

    (block_start, line_in_task) orders the lines of a file.
    """
    return spark.read.text(path).select(
        F.lit(request_id).alias("request_id"),
        F.lit(side).alias("side"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_task"),
        F.when(F.col("_metadata.file_block_start") == 0, without_bom(F.col("value"))).otherwise(F.col("value")).alias("line"),
    )


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """First n non-blank lines of every file of a line scan, numbered from 1.

    The rank filter is applied inside each map task before the exchange, so a single huge file sends n rows per task.
    """
    keys = [*FILE_KEYS, "file_path"]
    order = Window.partitionBy(*keys).orderBy("block_start", "line_in_task")
    kept = lines.filter(~is_blank(F.col("line"))).withColumn("line_no", F.row_number().over(order))
    return kept.filter(F.col("line_no") <= n).select(*keys, "line_no", "line")


def file_kind(file_name: Column) -> Column:
    ext = file_extension(file_name)
    return F.when(ext == "json", "json").when(ext.isin("csv", "tsv", "txt"), "delimited").otherwise("text")


def delimited_lines(files: DataFrame) -> DataFrame:
    """Add the voted delimiter and the non-blank lines of every file."""
    lines = F.filter(F.split(trim_script(F.col("content")), "\r?\n"), lambda line: ~is_blank(line))
    return files.withColumn("delimiter", vote_delimiter(first_line(F.col("content")))).withColumn("lines", lines)


def scan_delimited(files: DataFrame) -> DataFrame:
    """Rows of delimited text as (file, row_no, cells); row 0 is the header.

    For a directory that holds only large delimited files with one delimiter, use `spark.read.csv`, which also
    understands cells that span lines.
    """
    exploded = delimited_lines(files).select(*FILE_KEYS, "delimiter", F.posexplode("lines").alias("row_no", "line"))
    return exploded.select(*FILE_KEYS, "row_no", split_quoted(F.col("line"), F.col("delimiter")).alias("cells"))


def file_statistics(files: DataFrame) -> DataFrame:
    """Columns in the header and data rows of every file; no explode and no shuffle."""
    staged = delimited_lines(files)
    header = split_quoted(F.try_element_at("lines", F.lit(1)), F.col("delimiter"))
    return staged.select(
        *FILE_KEYS,
        "delimiter",
        F.greatest(F.size(F.coalesce(header, F.array().cast("array<string>"))), F.lit(0)).alias("n_columns"),
        F.greatest(F.size("lines") - 1, F.lit(0)).alias("n_rows"),
    )


def preview_rows(files: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows below the header, numbered from 1, with the number of rows left out."""
    staged = delimited_lines(files).withColumn("n_rows", F.greatest(F.size("lines") - 1, F.lit(0)))
    shown = staged.select(
        *FILE_KEYS,
        "delimiter",
        F.greatest(F.col("n_rows") - limit, F.lit(0)).alias("n_more"),
        F.posexplode(F.slice("lines", 2, limit)).alias("at", "line"),
    )
    return shown.select(
        *FILE_KEYS,
        (F.col("at") + 1).alias("row_no"),
        split_quoted(F.col("line"), F.col("delimiter")).alias("cells"),
        "n_more",
    )


PROFILE_NODES = "array<struct<path:string,depth:int,kind:string,n_children:int>>"
CHILD_NODES = "array<struct<path:string,node:variant>>"


def profile_json(files: DataFrame, max_depth: int = JSON_PROFILE_DEPTH) -> DataFrame:
    """Nodes of every JSON file: path, depth, kind, number of children.

    The walk is one fold over the depths inside the row: a file is parsed once and all its nodes leave through a single
    explode. A node below the depth limit is counted by its parent only.
    """

    def visit(path: Column, node: Column, depth: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
        keyed = F.transform(
            fields, lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("node"))
        )
        items = F.transform(
            F.try_variant_get(node, "$", "array<variant>"),
            lambda v, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("node")),
        )
        return F.struct(
            path.alias("path"),
            depth.alias("depth"),
            kind(node).alias("kind"),
            F.coalesce(keyed, items, F.array().cast(CHILD_NODES)).alias("children"),
        )

    def report(level: Column) -> Column:
        return F.transform(
            level, lambda n: F.struct(n["path"], n["depth"], n["kind"], F.size(n["children"]).alias("n_children"))
        ).cast(PROFILE_NODES)

    def step(state: Column, depth: Column) -> Column:
        below = F.transform(F.flatten(state["level"]["children"]), lambda c: visit(c["path"], c["node"], depth))
        return F.struct(F.concat(state["nodes"], report(state["level"])).alias("nodes"), below.alias("level"))

    root = F.array(visit(F.lit("$"), F.col("node"), F.lit(0)))
    start = F.struct(F.array().cast(PROFILE_NODES).alias("nodes"), root.alias("level"))
    depths = F.sequence(F.lit(1), F.lit(max_depth))
    walked = F.aggregate(depths, start, step, lambda s: F.concat(s["nodes"], report(s["level"])))
    parsed = stage(files.select(*FILE_KEYS, "content"), {"node": strict_json(F.col("content"))}).filter(F.col("node").isNotNull())
    return parsed.select(*FILE_KEYS, F.inline(walked))
