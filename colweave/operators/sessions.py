"""Joins and set operations of the session catalogue.

Tables: projects (id, owner_user_id, name, payload JSON columns, created_at, updated_at), project_shares (id,
project_id, shared_with_user_id, role, shared_at) and user_profiles (user_id, display_name, last_updated). Profile
lookups carry no broadcast hint: Spark broadcasts a profile table whose measured size is small, and splits the key of
an owner with very many sessions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.json_text import as_array, fits, is_object, strict_json
from colweave.functions.text import is_blank, iso_timestamp
from colweave.schemas import MAPPING_RESULT, SESSION_CHAT, SESSION_FILES, SESSION_RULES, SUGGESTION_LIMIT

LIST_COLUMNS = ("id", "name", "created_at", "updated_at", "owner_user_id")
PAYLOADS = {
    "source_files_json": ("source_files", SESSION_FILES),
    "target_files_json": ("target_files", SESSION_FILES),
    "chat_history_json": ("chat_history", SESSION_CHAT),
    "rules_json": ("rules", SESSION_RULES),
}


def owned_sessions(projects: DataFrame) -> DataFrame:
    """Every session under its owner; payload columns are left out and never read."""
    return projects.select(F.col("owner_user_id").alias("user_id"), *LIST_COLUMNS, F.lit(True).alias("is_owner"))


def shared_sessions(projects: DataFrame, shares: DataFrame) -> DataFrame:
    """Every session under each user it is shared with."""
    grants = shares.select(F.col("project_id").alias("id"), F.col("shared_with_user_id").alias("user_id"))
    return grants.join(projects.select(*LIST_COLUMNS), "id").select("user_id", *LIST_COLUMNS, F.lit(False).alias("is_owner"))


def with_display_name(df: DataFrame, profiles: DataFrame, key: str, name: str) -> DataFrame:
    """Left lookup of a user's display name; unknown users get null."""
    names = profiles.select(F.col("user_id").alias(key), F.col("display_name").alias(name))
    return df.join(names, key, "left")


def access_grants(projects: DataFrame, shares: DataFrame, role: str | None = None) -> DataFrame:
    """Distinct (id, user_id) pairs that may open a session: its owner, and users it is shared with in a role.

    Written as a union of keys for a semi-join: an EXISTS under OR could not be planned as one.
    """
    owners = projects.select("id", F.col("owner_user_id").alias("user_id"))
    shared = shares if role is None else shares.filter(F.col("role") == role)
    return owners.union(shared.select("project_id", "shared_with_user_id")).distinct()


def user_ids(projects: DataFrame, shares: DataFrame) -> DataFrame:
    """Distinct owners and share recipients."""
    return projects.select(F.col("owner_user_id").alias("user_id")).union(shares.select("shared_with_user_id")).distinct()


def session_exists(projects: DataFrame, condition: Column) -> DataFrame:
    """One row telling whether any session meets a condition; stops at the first one."""
    return projects.filter(condition).limit(1).agg((F.count("*") > 0).alias("exists"))


def first_session(projects: DataFrame, session_id: str) -> DataFrame:
    """The session of an id, or no row; the filter reaches the scan."""
    return projects.filter(F.col("id") == session_id).limit(1)


def new_grants(requested: DataFrame, shares: DataFrame) -> DataFrame:
    """Requested (project_id, shared_with_user_id) pairs that do not exist yet."""
    return requested.join(shares.select("project_id", "shared_with_user_id"), ["project_id", "shared_with_user_id"], "left_anti")


def unread_shared(listing: DataFrame, opened: DataFrame) -> DataFrame:
    """Per user, shared sessions not opened yet. `opened` holds user_id and id."""
    unread = listing.filter(~F.col("is_owner")).join(opened.select("user_id", "id"), ["user_id", "id"], "left_anti")
    return unread.groupBy("user_id").agg(F.count("*").alias("n_unread"))


def share_suggestions(candidates: DataFrame, shares: DataFrame, asks: DataFrame, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Users to suggest for each ask (project_id, user_id asking), without the asker and present recipients.

    The first candidates by name are at most `limit` rows and are read first; every ask then takes the present recipients
    among them from its list.
    """
    listed = candidates.orderBy("display_name", "user_id").limit(limit).select("user_id", "display_name").collect()
    if not listed:
        return asks.select("project_id", "user_id", F.lit("").alias("shared_with_user_id"), F.lit("").alias("display_name")).limit(0)
    people = F.array(*[F.struct(F.lit(u).alias("shared_with_user_id"), F.lit(n).alias("display_name")) for u, n in listed])
    present = shares.filter(F.col("shared_with_user_id").isin([u for u, _ in listed]))
    present = present.groupBy("project_id").agg(F.collect_set("shared_with_user_id").alias("present"))
    offered = asks.select("project_id", "user_id").join(present, "project_id", "left")
    missing = lambda p: (p["shared_with_user_id"] != F.col("user_id")) & ~F.array_contains(F.coalesce("present", F.array().cast("array<string>")), p["shared_with_user_id"])
    return offered.select("project_id", "user_id", F.inline(F.filter(people, missing)))


def decode_payloads(projects: DataFrame) -> DataFrame:
    """Payload columns as structures. Text that is not JSON, or has a value of the wrong kind anywhere, gives the default:
    an empty list, or no mapping."""
    decoded = projects
    for text, (name, schema) in PAYLOADS.items():
        value = strict_json(F.col(text))
        usable = as_array(value).isNotNull() & fits(value, schema)
        decoded = decoded.withColumn(name, F.coalesce(F.when(usable, F.from_json(text, schema)), F.array().cast(schema)))
    value = strict_json(F.col("current_mapping_json"))
    usable = is_object(value) & fits(value, MAPPING_RESULT)
    decoded = decoded.withColumn("current_mapping", F.when(usable, F.from_json("current_mapping_json", MAPPING_RESULT)))
    return decoded.drop(*PAYLOADS, "current_mapping_json")


def session_times(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", iso_timestamp(F.col("created_at"))).withColumn("updated_at", iso_timestamp(F.col("updated_at")))


def has_real_name() -> Column:
    """A display name that is present and is not merely the user id."""
    return ~is_blank(F.col("display_name")) & (F.col("display_name") != F.col("user_id"))
