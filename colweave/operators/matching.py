"""Deterministic column matching.

A source and a target column are scored by their names and type families. Names are alike in three ways, and the largest
counts: the longest run of consecutive tokens they share, over the tokens of both; the tokens they share in any order, over
all of theirs, if each has at most one that the other lacks; and their spelling, if one edit (a character changed, added or
left out) turns one into the other.

The best source of every target is found without comparing pairs. Each way is a set of keys that two names share exactly if
they are alike in that way: runs; sorted token sets, whole and without one token; spellings, with one character masked or
left out. A key keeps the best source that has it (a minimum, combined on the map side), and a target looks up its own keys.
Every key fixes the score of its sources but for their number of tokens, of which the least is best, so the best source
overall is always among the ones kept. Keys are hashed to 128 bits and sources numbered in order of their names, so the
minima are numbers; texts are fetched for the winners. Work grows with the number of columns, and a token that every column
has costs one row for each map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.staging import written
from colweave.operators.apply import TYPE_ALIASES
from colweave.operators.catalog import qualified_names

NAME_WEIGHT = 0.8
TYPE_WEIGHT = 0.2
ORDER_WEIGHT = 0.95
SPELLING_WEIGHT = 0.9
LEAST_RATIO = 0.75
ANY_FAMILY = "*"
# Two numbers in one decimal: the first times this, plus the second; scores count in steps of 10**-12.
PLACE = 1 << 63
SCORE_STEPS = 10**12

# Declared type names by family.
TYPE_FAMILIES = {
    "integer": ("int", "integer", "bigint", "smallint", "tinyint", "long", "short"),
    "number": ("decimal", "numeric", "double", "float", "real", "number"),
    "text": ("varchar", "string", "text", "char", "nvarchar", "nchar"),
    "date": ("date",),
    "timestamp": ("timestamp", "datetime", "timestamp_ntz"),
    "boolean": ("boolean", "bool"),
}


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name: snake case, camel case and any other separator."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def type_family(data_type: Column) -> Column:
    """Family of a declared type, the type itself where it is not known, empty where none is declared."""
    word = F.regexp_extract(F.lower(F.coalesce(data_type, F.lit(""))), r"^\s*(\w*)", 1)
    return reduce(
        lambda rest, item: F.when(word.isin(*item[1]), item[0]).otherwise(rest), TYPE_FAMILIES.items(), word
    )


def named_columns(catalog: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Distinct columns of both sides with an id in order of their names, tokens and type family.

    `synonyms` (name, canonical) replaces whole names, such as dob by birth date, before they are split. The table is
    written once; all steps of matching read it.
    """
    described = F.min(F.struct("table_name", "column_name", "data_type")).alias("c")
    columns = qualified_names(catalog).groupBy("request_id", "side", "qualified").agg(described)
    columns = columns.select("request_id", "side", "qualified", "c.table_name", "c.data_type", name_tokens(F.col("c.column_name")).alias("tokens"))
    if synonyms is not None:
        joined = lambda c: F.array_join(name_tokens(F.col(c)), " ")
        known = synonyms.select(joined("name").alias("_name"), name_tokens(F.col("canonical")).alias("_tokens")).dropDuplicates(["_name"])
        columns = columns.withColumn("_name", F.array_join("tokens", " ")).join(known, "_name", "left")
        columns = columns.withColumn("tokens", F.coalesce("_tokens", "tokens")).drop("_name", "_tokens")
    ordered = columns.withColumn("family", type_family(F.col("data_type"))).orderBy("request_id", "side", "qualified")
    return written(ordered.withColumn("id", F.monotonically_increasing_id()), "columns")


def _counted(n: Column, make) -> Column:
    """make(i) for i from 1 to n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make)).otherwise(F.array())


def _runs(tokens: Column) -> Column:
    """All runs of consecutive tokens, as (text, tokens)."""
    n = F.size(tokens)
    of = lambda s: _counted(n - s + 1, lambda k: F.struct(F.array_join(F.slice(tokens, s, k), " ").alias("text"), k.alias("n")))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of))


def _without_one(tokens: Column) -> Column:
    """A sorted set's texts without one of its tokens, where something is left."""
    shorter = lambda i: F.array_join(F.concat(F.slice(tokens, F.lit(1), i - 1), F.slice(tokens, i + 1, F.size(tokens))), " ")
    return F.when(F.size(tokens) > 1, _counted(F.size(tokens), shorter)).otherwise(F.array())


def _edited(word: Column, mark: str) -> Column:
    """The word with each of its characters replaced by the mark."""
    return _counted(F.char_length(word), lambda i: F.concat(F.left(word, i - 1), F.lit(mark), F.substring(word, i + 1, F.char_length(word))))


def _keys(kind: str, texts: Column, name_score, order=None) -> Column:
    """Keys of one kind: (kind and text, score of a name that shares it, order among sources)."""
    return F.transform(
        texts,
        lambda t: F.struct(
            F.concat(F.lit(kind), t["text"] if order is not None else t).alias("text"),
            (t["n"] if order is not None else F.lit(0)).alias("run"),
            (name_score if isinstance(name_score, Column) else F.lit(name_score)).cast("double").alias("name_score"),
            (order if order is not None else F.lit(0)).alias("order"),
        ),
    )


MASK = "\u0000"


def match_keys(tokens: Column, source: bool) -> Column:
    """Keys that a name offers as a source, or looks up as a target with what sharing them scores."""
    n, words = F.size(tokens), F.array_sort(F.array_distinct(tokens))
    spelling = F.array_join(tokens, "")
    size, long = F.size(words).cast("double"), F.char_length(spelling).cast("double")
    set_score = lambda shared, every: F.lit(ORDER_WEIGHT) * (shared / every)
    near = lambda longer: F.lit(SPELLING_WEIGHT) * (1 - 1 / longer)
    if_long = lambda texts, longer: F.when(1 - 1 / longer >= LEAST_RATIO, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))
    whole, fewer = F.array(F.array_join(words, " ")), _without_one(words)
    masked, left_out = if_long(_edited(spelling, MASK), long), if_long(_edited(spelling, ""), long)
    runs = _keys("r", F.array_distinct(_runs(tokens)), 0.0, n)
    if source:
        kinds = [runs, ("s", whole), ("t", fewer), ("e", F.array(spelling)), ("m", masked), ("d", left_out)]
        parts = [k if isinstance(k, Column) else _keys(*k, 0.0) for k in kinds]
    else:
        parts = [
            runs,
            _keys("s", whole, set_score(size, size)),
            _keys("t", whole, set_score(size, size + 1)),
            _keys("s", fewer, set_score(size - 1, size)),
            _keys("t", fewer, set_score(size - 1, size + 1)),
            _keys("e", F.array(spelling), SPELLING_WEIGHT),
            _keys("m", masked, near(long)),
            _keys("d", if_long(F.array(spelling), long + 1), near(long + 1)),
            _keys("e", left_out, near(long)),
        ]
    return F.when(n > 0, F.concat(*parts)).otherwise(F.array().cast("array<struct<text:string,run:int,name_score:double,order:int>>"))


def _keyed(columns: DataFrame, source: bool) -> DataFrame:
    """One row per column, key and type key (its own family, and any); keys as two hashes."""
    typed = F.explode(F.array(F.lit(ANY_FAMILY), "family")).alias("typed")
    keyed = columns.select("request_id", "id", F.size("tokens").alias("n_tokens"), "family", F.inline(match_keys(F.col("tokens"), source)))
    keyed = keyed.select("*", typed)
    parts = ("request_id", "typed", "text")
    return keyed.withColumn("h1", F.xxhash64(*parts)).withColumn("h2", F.xxhash64(F.lit(1), *parts))


def _pair(first: Column, second: Column) -> Column:
    """Two whole numbers as one decimal, which sorts like the pair."""
    return (first.cast("decimal(18,0)") * F.expr(f"{PLACE}BD") + second.cast("decimal(19,0)")).cast("decimal(38,0)")


def _first(pair: str) -> Column:
    return F.expr(f"cast({pair} div {PLACE}BD as bigint)")


def _second(pair: str) -> Column:
    return F.expr(f"cast({pair} % {PLACE}BD as bigint)")


def _merged(frame: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: rows made by a generator, or read from a small compressed file, take far
    more memory than Spark's estimate of them."""
    return frame.hint("merge")


def best_ids(named: DataFrame) -> DataFrame:
    """(id, source_id, score): the best source of every target that is like any; ties go to the first by name."""
    offered = _keyed(named.filter("side = 'source'"), True)
    index = offered.groupBy("h1", "h2").agg(F.min(_pair(F.col("order"), F.col("id"))).alias("kept"))
    wanted = _keyed(named.filter("side = 'target'"), False).select("id", "h1", "h2", "n_tokens", "run", "name_score", (F.col("typed") != ANY_FAMILY).alias("same_family"))
    found = _merged(wanted).join(index, ["h1", "h2"])
    run = F.col("run").cast("double")
    overlap = run / (_first("kept") + F.col("n_tokens") - run)
    score = F.lit(NAME_WEIGHT) * F.when(run > 0, overlap).otherwise(F.col("name_score")) + F.when(F.col("same_family"), F.lit(TYPE_WEIGHT)).otherwise(0.0)
    distance = F.lit(SCORE_STEPS) - F.round(score * SCORE_STEPS).cast("bigint")
    best = found.groupBy("id").agg(F.min(_pair(distance, _second("kept"))).alias("best"))
    return best.select("id", _second("best").alias("source_id"), ((F.lit(SCORE_STEPS) - _first("best")) / F.lit(float(SCORE_STEPS))).alias("score"))


def best_matches(named: DataFrame) -> DataFrame:
    """The targets that are like any source, each with its best source and their score."""
    sources = named.filter("side = 'source'").select(
        F.col("id").alias("source_id"), F.struct("qualified", "table_name", "family", "data_type", F.array_join("tokens", " ").alias("words")).alias("source")
    )
    targets = named.filter("side = 'target'").select("id", "request_id", "qualified", F.col("table_name").alias("target_table"))
    return best_ids(named).join(_merged(sources), "source_id").join(_merged(targets), "id").select("request_id", "qualified", "target_table", "score", "source")


def spark_type(data_type: Column) -> Column:
    """Declared type in Spark's spelling, for use in a suggested rule."""
    upper = F.upper(data_type)
    return reduce(lambda rest, alias: F.when(upper == alias[0], alias[1]).otherwise(rest), TYPE_ALIASES.items(), upper)


def aligned_tables(matches: DataFrame) -> DataFrame:
    """For each target table the source table that most of its best matches come from."""
    votes = matches.groupBy("request_id", "target_table", F.col("source.table_name").alias("source_table")).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("order"), "source_table"))
    return votes.groupBy("request_id", "target_table").agg(first["source_table"].alias("source_table"))


def derived_matches(named: DataFrame, matches: DataFrame) -> DataFrame:
    """Targets whose name is made up of several whole source names of the aligned table.

    A target has few runs and each names at most one column of the aligned table, so what is gathered per target is
    bounded by its own name.
    """
    sources, targets = named.filter("side = 'source'"), named.filter("side = 'target'")
    tables = aligned_tables(matches)
    n = F.size("tokens")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda s: F.transform(
                F.sequence(F.lit(1), n - s + 1),
                lambda k: F.struct(s.alias("first"), (s + k - 1).alias("last"), F.array_join(F.slice("tokens", s, k), " ").alias("words")),
            ),
        )
    )
    wanted = targets.filter(n > 1).select("request_id", "qualified", F.col("table_name").alias("target_table"), n.alias("n_tokens"), F.inline(spans))
    wanted = _merged(wanted.filter((F.col("last") - F.col("first") + 1) < F.col("n_tokens"))).join(tables, ["request_id", "target_table"])
    named = sources.groupBy("request_id", F.col("table_name").alias("source_table"), F.array_join("tokens", " ").alias("words")).agg(
        F.min("qualified").alias("source")
    )
    parts = _merged(wanted).join(named, ["request_id", "source_table", "words"]).groupBy("request_id", "qualified", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "source"))).alias("found")
    )
    # Keep the widest spans only, then ask whether they cover the whole name.
    widest = F.filter(
        "found",
        lambda a: ~F.exists("found", lambda b: (b["first"] <= a["first"]) & (b["last"] >= a["last"]) & ((b["last"] - b["first"]) > (a["last"] - a["first"]))),
    )
    covered = F.forall(F.sequence(F.lit(1), F.col("n_tokens")), lambda p: F.exists("kept", lambda k: (k["first"] <= p) & (k["last"] >= p)))
    kept = parts.withColumn("kept", widest).filter((F.size("kept") > 1) & covered)
    names = F.array_distinct(F.transform("kept", lambda k: k["source"]))
    return kept.select("request_id", "qualified", names.alias("derived_from")).filter(F.size("derived_from") > 1)


def match_columns(catalog: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One mapping item per target column of a catalogue."""
    named = named_columns(catalog, synonyms)
    matches = written(best_matches(named), "matches")
    derived = written(derived_matches(named, matches), "derived")
    targets = named.filter("side = 'target'").select("request_id", "qualified", "data_type", "family", "tokens")
    joined = targets.join(_merged(matches.drop("target_table")), ["request_id", "qualified"], "left").join(_merged(derived), ["request_id", "qualified"], "left")

    matched = F.col("source").isNotNull()
    same_name = F.col("source.words") == F.array_join("tokens", " ")
    same_type = F.col("source.family") == F.col("family")
    is_derived = F.col("derived_from").isNotNull() & ~F.coalesce(same_name, F.lit(False))
    untyped = (F.col("family") == "") | (F.col("source.family") == "")
    match_type = (
        F.when(is_derived, "derived")
        .when(~matched, "incompatible")
        .when(~same_type & ~untyped, "transformed")
        .when(same_name & same_type, "exact")
        .otherwise("semantic")
    )
    source = F.col("source.qualified")
    rule = F.when(is_derived, F.format_string("CONCAT_WS(' ', %s)", F.array_join("derived_from", ", "))).when(
        match_type == "transformed", F.format_string("CAST(%s AS %s)", source, spark_type(F.col("data_type")))
    )
    return joined.select(
        "request_id",
        F.col("qualified").alias("target_column"),
        F.when(is_derived, F.col("derived_from")).when(matched, F.array(source)).otherwise(F.array().cast("array<string>")).alias("source_columns"),
        F.coalesce("score", F.lit(0.0)).alias("confidence_score"),
        match_type.alias("match_type"),
        F.when(is_derived, "name is made up of several source columns").when(matched, F.format_string("its name is like %s", source)).otherwise("no source column has a name like it").alias("reasoning"),
        rule.alias("transformation_rule"),
    )


def _references(items: DataFrame, *targets: Column) -> DataFrame:
    """(request_id, side, qualified) of the columns that items name, in one pass."""
    sources = F.transform("source_columns", lambda c: F.struct(F.lit("source").alias("side"), c.alias("qualified")))
    return items.select("request_id", F.inline(F.concat(sources, *targets)))


def unknown_references(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Source and target columns named by items that the catalogue does not have."""
    target = F.array(F.struct(F.lit("target").alias("side"), F.col("target_column").alias("qualified")))
    known = qualified_names(catalog).select("request_id", "side", "qualified")
    return _references(items, target).distinct().join(_merged(known), ["request_id", "side", "qualified"], "left_anti")


def coverage(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Source columns no item uses, and target columns no item fills."""
    target = F.array(F.struct(F.lit("target").alias("side"), F.col("target_column").alias("qualified")))
    filled = F.when(F.size("source_columns") > 0, target).otherwise(F.array().cast("array<struct<side:string,qualified:string>>"))
    known = qualified_names(catalog).select("request_id", "side", "qualified").distinct()
    return known.join(_merged(_references(items, filled)), ["request_id", "side", "qualified"], "left_anti")
