"""Token budget per request, tier choice and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.staging import written
from colweave.functions.text import estimate_tokens, is_blank, null_if_blank, tokens_for_length, trim_ws
from colweave.operators.reduction import file_lengths, reduce_to_tier
from colweave.schemas import (
    DEFAULT_TOKEN_LIMIT,
    FILE_OVERHEAD_TOKENS,
    FIXED_OVERHEAD_TOKENS,
    REDUCTION_LEVELS,
    RESPONSE_BUFFER_TOKENS,
    SYSTEM_PROMPT_TOKENS,
    TIER_LABELS,
)

# The wording of a prompt.
PROMPT_HEAD = (
    "Analyze the following raw SOURCE and TARGET files. Extract all tables/columns from each file, then produce a "
    "complete column-level mapping. Return ONLY valid JSON matching the expected output format."
)
INSTRUCTION_HEAD = "\n\nUser's instruction: "
RULES_HEAD = "\n\nADDITIONAL RULES (you MUST follow these):\n"
SOURCE_HEAD = "\n=== SOURCE FILES ===\n"
TARGET_HEAD = "\n=== TARGET FILES ===\n"
FILE_PATTERN = "\n--- File: %s ---\n%s\n"
MAPPING_HEAD = "\nCURRENT_MAPPING:\n"
REFINE_RULES_HEAD = "\nADDITIONAL RULES (you MUST follow these):\n"

ALL_TIERS = ("raw", *REDUCTION_LEVELS)


def rules_text(contents: Column) -> Column:
    """Rule contents joined by a blank line; null where that leaves nothing."""
    return F.nullif(F.array_join(contents, "\n\n"), F.lit(""))


def _optional_tokens(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(0)).otherwise(estimate_tokens(c)).cast("bigint")


def request_totals(files: DataFrame) -> DataFrame:
    """Per request: files on each side, bytes, and file tokens at every tier.

    Only lengths leave the scan stage; the sums combine on the map side, so a request with very many files costs its
    reducer one row per map task.
    """
    sizes = file_lengths(files)
    overhead = estimate_tokens(F.col("file_name")) + FILE_OVERHEAD_TOKENS
    sums = [
        F.sum(tokens_for_length(F.col(f"len_{tier}")) + overhead).cast("bigint").alias(f"file_tokens_{tier}")
        for tier in ALL_TIERS
    ]
    return sizes.groupBy("request_id").agg(
        F.count_if(F.col("side") == "source").alias("n_source"),
        F.count_if(F.col("side") == "target").alias("n_target"),
        F.sum("n_bytes").cast("bigint").alias("n_bytes"),
        *sums,
    )


def estimate_requests(
    files: DataFrame, requests: DataFrame, system_prompt_tokens: int = SYSTEM_PROMPT_TOKENS
) -> DataFrame:
    """Prompt estimate of every request at every tier. `requests` holds request_id, user_instruction, rules."""
    fixed = system_prompt_tokens + FIXED_OVERHEAD_TOKENS + RESPONSE_BUFFER_TOKENS
    extra = _optional_tokens(F.col("user_instruction")) + _optional_tokens(F.col("rules")) + F.lit(fixed)
    totals = requests.join(request_totals(files), "request_id", "left")
    return totals.select(
        "request_id",
        "user_instruction",
        "rules",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_source", "n_target", "n_bytes")],
        *[
            (F.coalesce(F.col(f"file_tokens_{tier}"), F.lit(0)) + extra).cast("bigint").alias(f"tokens_{tier}")
            for tier in ALL_TIERS
        ],
    )


def choose_tier(estimates: DataFrame, token_limit: int = DEFAULT_TOKEN_LIMIT) -> DataFrame:
    """First tier whose estimate fits; the heavy tier is taken even where it does not."""
    fits = lambda tier: F.col(f"tokens_{tier}") <= token_limit
    tier = F.when(fits("raw"), "raw").when(fits("light"), "light").when(fits("medium"), "medium").otherwise("heavy")
    tokens = F.lit(None).cast("bigint")
    for name in ALL_TIERS:
        tokens = F.when(F.col("tier") == name, F.col(f"tokens_{name}")).otherwise(tokens)
    label = F.lit(None).cast("string")
    for name, text in TIER_LABELS.items():
        label = F.when(F.col("tier") == name, F.lit(text)).otherwise(label)
    return estimates.withColumn("tier", tier).withColumn("tier_label", label).withColumn("tier_tokens", tokens)


def reject_reason(refine: bool = False) -> Column:
    """Why a request is refused, null where it is complete. Refine requests need a mapping and a message as well."""
    missing = (F.col("n_source") == 0) | (F.col("n_target") == 0)
    if refine:
        missing = missing | F.col("current_mapping").isNull() | is_blank(F.col("user_message"))
        return F.when(missing, "a refine request needs files of both sides, a mapping and a message")
    return F.when(missing, "a request needs files of both sides")


def plan_requests(files: DataFrame, requests: DataFrame, token_limit: int = DEFAULT_TOKEN_LIMIT) -> DataFrame:
    """One row per request: estimates, tier, and the reason it is refused, if any."""
    return choose_tier(estimate_requests(files, requests), token_limit).withColumn("reject_reason", reject_reason())


def prompt_segments(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The prompt of every accepted request as ordered text segments, one row per file and heading.

    The segment form has no size limit: nothing is gathered per request. Sizes were summed in a first, length-only
    pass, whose plan is written once, so file text is read once more and crosses the network once, already reduced where
    the plan table is small enough for Spark to broadcast it.
    """
    accepted = written(plan.filter(F.col("reject_reason").isNull()).select("request_id", "user_instruction", "rules", "tier"), "plan")
    head = F.concat(
        F.lit(PROMPT_HEAD),
        F.coalesce(F.concat(F.lit(INSTRUCTION_HEAD), null_if_blank(F.col("user_instruction"))), F.lit("")),
        F.coalesce(F.concat(F.lit(RULES_HEAD), null_if_blank(F.col("rules"))), F.lit("")),
        F.lit("\n" + SOURCE_HEAD),
    )
    parts = F.array(
        F.struct(F.lit(0).alias("block"), head.alias("text")),
        F.struct(F.lit(2).alias("block"), F.lit(TARGET_HEAD).alias("text")),
    )
    headings = accepted.select("request_id", F.inline(parts)).select(
        "request_id", "block", F.lit(0).cast("bigint").alias("pos"), "text"
    )
    return headings.unionByName(file_segments(files, accepted.select("request_id", "tier")))


def file_segments(files: DataFrame, tiers: DataFrame) -> DataFrame:
    """File blocks of the given requests at the tier each was assigned."""
    reduced = reduce_to_tier(files.join(tiers, "request_id"))
    return reduced.select(
        "request_id",
        F.when(F.col("side") == "source", 1).otherwise(3).alias("block"),
        F.col("pos").cast("bigint").alias("pos"),
        F.format_string(FILE_PATTERN, "file_name", "content").alias("text"),
    )


def assemble_segments(segments: DataFrame, name: str = "prompt") -> DataFrame:
    """Join the segments of each request in order.

    A prompt is one text, already reduced to its tier; a prompt that a string cannot hold stays in the segment form.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block", "pos", "text")))
    return segments.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias(name))


def build_prompts(files: DataFrame, plan: DataFrame) -> DataFrame:
    return assemble_segments(prompt_segments(files, plan))


def rejected_refinements(files: DataFrame, refinements: DataFrame) -> DataFrame:
    """request_id and reason of every refine request that gets no context."""
    return _sized_refinements(files, refinements).filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")


def _sized_refinements(files: DataFrame, refinements: DataFrame) -> DataFrame:
    sizes = files.groupBy("request_id").agg(
        F.count_if(F.col("side") == "source").alias("n_source"), F.count_if(F.col("side") == "target").alias("n_target")
    )
    known = refinements.join(sizes, "request_id", "left").fillna(0, ["n_source", "n_target"])
    return known.withColumn("reject_reason", reject_reason(refine=True))


def refine_contexts(files: DataFrame, refinements: DataFrame, system_prompt: str = "") -> DataFrame:
    """Message list of every refine request.

    `refinements` holds request_id, current_mapping (struct), rules, messages (array of role and content) and
    user_message. Files are never reduced here.
    """
    accepted = written(_sized_refinements(files, refinements).filter(F.col("reject_reason").isNull()), "refinements")

    tail = F.concat(
        F.lit(MAPPING_HEAD),
        F.to_json(_pretty_names(F.col("current_mapping")), {"pretty": "true", "ignoreNullFields": "false"}),
        F.lit("\n"),
        F.coalesce(F.concat(F.lit(REFINE_RULES_HEAD), null_if_blank(F.col("rules")), F.lit("\n")), F.lit("")),
    )
    parts = F.array(
        F.struct(F.lit(0).alias("block"), F.lit(SOURCE_HEAD).alias("text")),
        F.struct(F.lit(2).alias("block"), F.lit(TARGET_HEAD).alias("text")),
        F.struct(F.lit(4).alias("block"), tail.alias("text")),
    )
    fixed = accepted.select("request_id", F.inline(parts)).select(
        "request_id", "block", F.lit(0).cast("bigint").alias("pos"), "text"
    )
    tiers = accepted.select("request_id", F.lit("raw").alias("tier"))
    context = assemble_segments(fixed.unionByName(file_segments(files, tiers)), "context")

    def message(role: str | Column, content: Column) -> Column:
        role = F.lit(role) if isinstance(role, str) else role
        return F.struct(role.alias("role"), content.alias("content"))

    history = F.transform(
        F.coalesce("messages", F.array()),
        lambda m: message(F.when(m["role"] == "assistant", "assistant").otherwise("user"), m["content"]),
    )
    return accepted.join(context, "request_id").select(
        "request_id",
        F.concat(
            F.array(message("system", F.concat(F.lit(system_prompt + "\n\n"), "context"))),
            history,
            F.array(message("user", trim_ws(F.col("user_message")))),
        ).alias("messages"),
    )


def _pretty_names(mapping: Column) -> Column:
    """The mapping under the names its serialised form uses inside a refine prompt."""
    items = F.transform(
        mapping["mappings"],
        lambda m: F.struct(
            m["target_column"].alias("TargetColumn"),
            m["source_columns"].alias("SourceColumns"),
            m["confidence_score"].alias("ConfidenceScore"),
            m["match_type"].alias("MatchType"),
            m["reasoning"].alias("Reasoning"),
            m["transformation_rule"].alias("TransformationRule"),
        ),
    )
    return F.struct(
        items.alias("Mappings"),
        mapping["unmapped_source_columns"].alias("UnmappedSourceColumns"),
        mapping["unmapped_target_columns"].alias("UnmappedTargetColumns"),
        mapping["global_confidence"].alias("GlobalConfidence"),
        mapping["analysis_summary"].alias("AnalysisSummary"),
    )
