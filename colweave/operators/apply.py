"""Applying a mapping to data: rules are Spark SQL expressions over the source DataFrame, or queries over source tables.

What a rule may do is decided on its analysed plan. An expression has to be a projection of its table that gives one value
for each row, the same in every run; so generators, windows, subqueries and values of the moment are refused, however they
are written, and any other function is allowed. A query may filter, join on a condition, group, and unite its registered
tables, and has to give one row for each key of the target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.functions.confidence import column_part, is_mapped, table_part

# Type names and calls of the rule language that Spark spells differently.
TYPE_ALIASES = {"VARCHAR": "STRING", "DATETIME": "TIMESTAMP"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
# Calls that the text of a rule may make where no table is at hand to analyse it: one value for each row, the same in every run.
ALLOWED_CALLS = frozenset((
    "abs", "add_months", "array", "array_contains", "array_join", "base64", "bigint", "bin", "bit_length", "boolean",
    "btrim", "cast", "ceil", "ceiling", "char", "char_length", "character_length", "chr", "coalesce", "concat",
    "concat_ws", "contains", "conv", "convert", "crc32", "date", "date_add", "date_diff", "date_format",
    "date_from_unix_date", "date_sub", "date_trunc", "dateadd", "datediff", "day", "dayofmonth", "dayofweek",
    "dayofyear", "decimal", "decode", "double", "element_at", "elt", "encode", "endswith", "exp", "extract",
    "find_in_set", "float", "floor", "format_number", "format_string", "from_unixtime", "from_utc_timestamp",
    "get_json_object", "greatest", "hash", "hex", "hour", "if", "ifnull", "initcap", "instr", "int", "isnan",
    "isnotnull", "isnull", "last_day", "lcase", "least", "left", "length", "levenshtein", "ln", "locate", "log",
    "log10", "log2", "lower", "lpad", "ltrim", "make_date", "make_timestamp", "map", "mask", "md5", "minute", "mod",
    "month", "months_between", "named_struct", "nanvl", "negative", "next_day", "nullif", "nvl", "nvl2",
    "octet_length", "overlay", "position", "pow", "power", "printf", "quarter", "regexp_extract", "regexp_like",
    "regexp_replace", "regexp_substr", "repeat", "replace", "reverse", "right", "rint", "round", "rpad", "rtrim",
    "second", "sha", "sha1", "sha2", "sign", "signum", "smallint", "soundex", "split", "split_part", "sqrt",
    "startswith", "string", "struct", "substr", "substring", "substring_index", "timestamp", "timestamp_micros",
    "timestamp_millis", "timestamp_seconds", "tinyint", "to_char", "to_date", "to_json", "to_number", "to_timestamp",
    "to_utc_timestamp", "translate", "trim", "trunc", "try_add", "try_cast", "try_divide", "try_element_at",
    "try_multiply", "try_subtract", "try_to_number", "try_to_timestamp", "ucase", "unbase64", "unhex", "unix_date",
    "unix_timestamp", "upper", "weekday", "weekofyear", "when", "xxhash64", "year",
))
# Words before a parenthesis that are no calls, and values that differ between runs without one.
OPERATORS = frozenset((
    "and", "or", "not", "in", "like", "rlike", "ilike", "between", "is", "case", "when", "then", "else", "end", "from", "for", "as", "distinct", "varchar", "decimal", "numeric", "array", "map", "struct",
))
CHANGING_WORDS = frozenset((
    "current_timestamp", "current_date", "current_time", "current_user", "localtimestamp", "now", "session_user", "user", "current_timezone",
))


class MappingError(ValueError):
    """A mapping that cannot be applied as it stands."""


@dataclass(frozen=True)
class Rule:
    """One target column and the expression that fills it."""

    target: str
    expression: str
    data_type: str | None = None
    source: str | None = None  # the plain source column, where the rule is only a copy


def _outside_literals(text: str, change) -> str:
    """Apply a function to the parts of a rule outside quoted literals and quoted names."""
    parts = re.split(r"""('(?:[^']|'')*'|`[^`]*`|"[^"]*")""", text)
    return "".join(part if i % 2 else change(part) for i, part in enumerate(parts))


def _convert_calls(text: str) -> str:
    """CONVERT(type, value) -> CAST(value AS type); the value runs to the closing parenthesis of the call."""
    found = re.search(r"\bCONVERT\s*\(", text, re.IGNORECASE)
    if not found:
        return text
    depth, comma, in_quote = 1, None, False
    for at in range(found.end(), len(text)):
        ch = text[at]
        in_quote ^= ch == "'"
        if in_quote:
            continue
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 1 and comma is None:
            comma = at
        if depth == 0 and comma is not None:
            kind, value = text[found.end() : comma].strip(), text[comma + 1 : at].strip()
            return f"{text[: found.start()]}CAST({_convert_calls(value)} AS {kind}){_convert_calls(text[at + 1 :])}"
    return text


def to_spark_sql(rule: str) -> str:
    """A rule in Spark's spelling: CONVERT becomes CAST, and bare VARCHAR and DATETIME get Spark's type names."""
    text = _convert_calls(rule)
    for name, spark_name in TYPE_ALIASES.items():
        text = _outside_literals(text, lambda s, n=name, t=spark_name: re.sub(rf"\b{n}\b(?!\s*\()", t, s, flags=re.IGNORECASE))
    return text


def _nested(depth: int) -> str:
    """Text with balanced parentheses up to a depth, and literals."""
    inner = rf"|\((?:{_nested(depth - 1)})*+\)" if depth else ""
    return rf"[^()']|'(?:[^']|'')*+'{inner}"


LITERAL = r"'(?:[^']|'')*+'"
CONVERT_CALL = rf"(?i)\bCONVERT\s*\(\s*(\w+(?:\s*\([\d\s,]*\))?)\s*,\s*((?:{_nested(6)})*+)\)"
NESTED_CONVERTS = 4


def spark_spelling(rule: Column) -> Column:
    """`to_spark_sql` for a column of rules, for calls nested up to four times with six levels of parentheses.

    A rule that has the words inside a literal is left as it is.
    """
    words = r"(?i)\b(CONVERT\s*\(|VARCHAR\b|DATETIME\b)"
    changed = rule
    for _ in range(NESTED_CONVERTS):
        changed = F.regexp_replace(changed, CONVERT_CALL, "CAST($2 AS $1)")
    for name, spark_name in TYPE_ALIASES.items():
        changed = F.regexp_replace(changed, rf"(?i)\b{name}\b(?!\s*\()", spark_name)
    quoted = F.exists(F.regexp_extract_all(rule, F.lit(LITERAL), F.lit(0)), lambda x: x.rlike(words))
    return F.when(rule.rlike(words) & ~quoted, changed).otherwise(rule)


def check_rule(rule: str, grouped: bool = False) -> None:
    """Refuse by its text what a column rule may not do: query other tables, differ between runs, or change the row count.

    For rules that are written before their table is known; `check_on` decides where it is. Calls must be on the list of
    allowed ones, quoted or not; aggregates are allowed under group keys only. Literals and quoted names are left out, and
    a bare name is a column whatever keyword it resembles.
    """
    if re.search(r"[`\"]\s*\(", re.sub(r"'(?:[^'\\]|''|\\.)*'", "''", rule)):
        raise MappingError(f"a quoted name cannot be called: {rule}")
    bare = " ".join(re.split(r"""'(?:[^'\\]|''|\\.)*'|`[^`]*`|"[^"]*\"""", rule))
    if re.search(r"\bSELECT\b|;|--|/\*", bare, re.IGNORECASE):
        raise MappingError(f"a rule cannot be a query: {rule}")
    if re.search(r"\)\s*OVER\b|\bWITHIN\s+GROUP\b|\)\s*FILTER\s*\(", bare, re.IGNORECASE):
        raise MappingError(f"windows are not allowed in a rule: {rule}")
    for name in re.findall(r"([\w.]+)\s*\(", bare):
        call = name.lower()
        if call in OPERATORS or call in ALLOWED_CALLS or (grouped and call.upper() in AGGREGATES):
            continue
        raise MappingError(f"{name}() is not allowed in a rule: {rule}")
    for word in re.findall(r"(?<![\w.])[A-Za-z_]\w*", bare):
        if word.lower() in CHANGING_WORDS:
            raise MappingError(f"{word} differs between runs: {rule}")


# ---- analysed plans -------------------------------------------------------------------------------------------------

# Expressions whose value depends on when, where or by whom a query is run, though Spark folds them within one run.
OF_THE_MOMENT = frozenset((
    "CurrentTimestamp", "Now", "CurrentDate", "CurrentTime", "CurDateExpressionBuilder", "LocalTimestamp", "CurrentTimeZone", "CurrentUser", "SessionUser",
    "CurrentDatabase", "CurrentCatalog", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "SparkPartitionID", "MonotonicallyIncreasingID",
))
SUBQUERIES = frozenset(("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "DynamicPruningSubquery"))


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.length())]


def _expressions(root) -> Iterator:
    yield root
    for child in _seq(root.children()):
        yield from _expressions(child)


def _faults(node, rule: str) -> None:
    """Refuse expressions of a plan node that read other tables or differ between runs."""
    for root in _seq(node.expressions()):
        if not root.deterministic():
            raise MappingError(f"its value differs between runs: {rule}")
        for e in _expressions(root):
            kind = e.getClass().getSimpleName()
            if kind in OF_THE_MOMENT:
                raise MappingError(f"{e.prettyName()} differs between runs: {rule}")
            if kind in SUBQUERIES:
                raise MappingError(f"a rule cannot hold a query: {rule}")


def check_on(df: DataFrame, *rules: str) -> None:
    """Refuse rules unless each is, on this table, one value for each row that is the same in every run.

    All are analysed together; where that fails, one by one, to name the rule at fault.
    """
    try:
        plan = df.select(*[F.expr(rule) for rule in rules])._jdf.queryExecution().analyzed()
        own = df._jdf.queryExecution().analyzed()
        if plan.nodeName() != "Project" or not plan.children().apply(0).sameResult(own):
            raise MappingError(f"a rule gives one value for each row, without generators, aggregates and windows: {rules[0]}")
        _faults(plan, rules[0])
    except (AnalysisException, ParseException, MappingError) as e:
        if len(rules) > 1:
            for rule in rules:
                check_on(df, rule)
        if isinstance(e, MappingError):
            raise
        raise MappingError(f"{rules[0]}: {e}") from e


@dataclass(frozen=True)
class QueryRule:
    """A target column filled by a query over registered tables, which gives the keys and, last, the value."""

    target: str
    query: str
    keys: tuple[str, ...]


# Plan nodes a query may consist of, and why others are refused.
QUERY_NODES = frozenset(("Project", "Filter", "Join", "Aggregate", "Union", "Distinct", "SubqueryAlias", "View", "Subquery"))
REFUSED_NODES = {
    "Sort": "a target table has no order (ORDER BY)",
    "GlobalLimit": "rows would be lost (LIMIT)",
    "LocalLimit": "rows would be lost (LIMIT)",
    "Offset": "rows would be lost (OFFSET)",
    "Tail": "rows would be lost (TAIL)",
    "Sample": "rows would be lost (TABLESAMPLE)",
    "Window": "windows are not part of the rule language",
    "Generate": "generators change the number of rows",
}


def _check_query(node, tables: set[str], rule: str) -> None:
    kind = node.nodeName()
    if kind in REFUSED_NODES:
        raise MappingError(f"{REFUSED_NODES[kind]}: {rule}")
    if kind not in QUERY_NODES:
        raise MappingError(f"only the registered tables can be read ({kind}): {rule}")
    if kind == "SubqueryAlias" and node.children().apply(0).nodeName() == "View" and node.alias() in tables:
        return
    if kind == "Join" and node.condition().isEmpty():
        raise MappingError(f"a join needs a condition (ON): {rule}")
    _faults(node, rule)
    children = _seq(node.children())
    if not children:
        raise MappingError(f"only the registered tables can be read ({kind}): {rule}")
    for child in children:
        _check_query(child, tables, rule)


def checked_query(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """A query over the tables under their names, refused unless its plan is made of what a rule may do."""
    taken = [name for name in tables if spark.catalog.tableExists(name)]
    if taken:
        raise MappingError(f"the session already has tables named {taken}")
    try:
        for name, df in tables.items():
            df.createTempView(name)
        result = spark.sql(to_spark_sql(query))
        plan = result._jdf.queryExecution().analyzed()
    except (AnalysisException, ParseException) as e:
        raise MappingError(f"{query}: {e}") from e
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    _check_query(plan, set(tables), query)
    return result


def query_mapping(rows: DataFrame, tables: dict[str, DataFrame], rules: list[QueryRule]) -> DataFrame:
    """Target rows with columns filled by queries, looked up by key; a key without a row gets null.

    A query that gives a key more than one row fails, when it runs, instead of multiplying the target's rows.
    """
    _refuse_repeated([r.target for r in rules])
    for rule in rules:
        found = checked_query(rows.sparkSession, tables, rule.query)
        if len(found.columns) != len(rule.keys) + 1:
            raise MappingError(f"a query gives its keys and one value: {rule.query}")
        found = found.toDF(*[f"_key{i}" for i in range(len(rule.keys))], "_value")
        each = found.groupBy(*found.columns[:-1]).agg(F.count("*").alias("_n"), F.min("_value").alias("_value"))
        message = F.lit(f"the rule of {rule.target} gives a key several rows")
        value = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_value"))
        same = [rows[quote_name(k)] == F.col(f"_key{i}") for i, k in enumerate(rule.keys)]
        kept = [rows[quote_name(c)] for c in rows.columns if c != rule.target]
        rows = rows.join(each, same, "left").select(*kept, value.alias(rule.target))
    return rows


def quote_name(qualified: str) -> str:
    return ".".join(f"`{part}`" for part in qualified.split("."))


def applicable_items(items: DataFrame) -> DataFrame:
    """Items that can fill a target: mapped, and not marked incompatible."""
    return items.filter(is_mapped(F.col("source_columns")) & (F.coalesce("match_type", F.lit("")) != "incompatible"))


def rules_for(items: DataFrame, target_table: str | None = None, types: dict[str, str] | None = None) -> list[Rule]:
    """Read the rules of one target table to the driver, in mapping order.

    A mapping has one row per column, so its size is that of a schema, not of the data.
    """
    chosen = applicable_items(items)
    if target_table is not None:
        chosen = chosen.filter(table_part(F.col("target_column")) == target_table)
    order = ["pos"] if "pos" in chosen.columns else []
    rows = (
        chosen.select(column_part(F.col("target_column")).alias("target"), "source_columns", "transformation_rule", *order)
        .orderBy(*order or ["target"])
        .collect()
    )
    return [_rule(r["target"], list(r["source_columns"]), r["transformation_rule"], (types or {}).get(r["target"])) for r in rows]


def _rule(target: str, sources: list[str], rule: str | None, data_type: str | None) -> Rule:
    if rule and rule.strip():
        return Rule(target, to_spark_sql(rule), data_type)
    if len(sources) > 1:
        raise MappingError(f"{target} has several sources and no rule to combine them")
    return Rule(target, quote_name(sources[0]), data_type, source=sources[0])


def _typed(rule: Rule) -> Column:
    value = F.expr(rule.expression)
    return value.try_cast(to_spark_sql(rule.data_type)) if rule.data_type else value


def project_mapping(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Projection form: every rule sees the input columns, the output has exactly the target columns.

    One narrow select: filters and column pruning reach the scan, and nothing shuffles.
    """
    if rules:
        check_on(df, *[r.expression for r in rules])
    _refuse_repeated([r.target for r in rules])
    return df.select(*[_typed(r).alias(r.target) for r in rules])


def chain_mapping(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Chained form: rules apply in order, later ones see earlier results, other columns stay.

    A rule without an expression renames its source. Renames of a missing column and onto an existing one, which
    Spark accepts silently, are refused.
    """
    for rule in rules:
        if rule.source is None:
            check_on(df, rule.expression)
            df = df.withColumn(rule.target, _typed(rule))
            continue
        source = rule.source.split(".")[-1]
        if source not in df.columns:
            raise MappingError(f"cannot rename {source}: no such column")
        if source != rule.target:
            if rule.target in df.columns:
                raise MappingError(f"cannot rename {source} to {rule.target}: the name is taken")
            df = df.withColumnRenamed(source, rule.target)
        if rule.data_type:
            df = df.withColumn(rule.target, F.col(rule.target).try_cast(to_spark_sql(rule.data_type)))
    return df


def aggregate_mapping(df: DataFrame, rules: list[Rule], group_keys: list[str]) -> DataFrame:
    """Rules with aggregates, under explicit group keys; rules on the keys themselves pass through."""
    for rule in rules:
        check_rule(rule.expression, grouped=True)
    _refuse_repeated([r.target for r in rules])
    is_aggregate = lambda r: any(re.search(rf"\b{a}\s*\(", r.expression, re.IGNORECASE) for a in AGGREGATES)
    measures = [_typed(r).alias(r.target) for r in rules if is_aggregate(r)]
    keyed = df.groupBy(*group_keys).agg(*measures) if measures else df.select(*group_keys).distinct()
    plain = {r.target: _typed(r).alias(r.target) for r in rules if not is_aggregate(r)}
    return keyed.select(*[plain.get(r.target, F.col(quote_name(r.target))) for r in rules])


def join_sources(tables: dict[str, DataFrame], keys: list[str], first: str) -> DataFrame:
    """Source tables under their names, so that `table.column` resolves in rules, joined by the caller's conditions."""
    joined = tables[first].alias(first)
    for (name, df), condition in zip([(n, d) for n, d in tables.items() if n != first], keys, strict=True):
        joined = joined.join(df.alias(name), F.expr(condition), "left")
    return joined


def cast_failures(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per typed target column: rows with a value before the cast and none after it. One pass, one row per column."""
    typed = [r for r in rules if r.data_type]
    counts = [
        F.struct(
            F.lit(r.target).alias("target"),
            F.lit(r.data_type).alias("data_type"),
            F.count_if(F.expr(r.expression).isNotNull() & _typed(r).isNull()).alias("n_failed"),
        )
        for r in typed
    ]
    return df.select("*").agg(F.array(*counts).alias("report")).select(F.inline("report"))


def _refuse_repeated(names: list[str]) -> None:
    repeated = {n for n in names if names.count(n) > 1}
    if repeated:
        raise MappingError(f"repeated target columns: {sorted(repeated)}")
