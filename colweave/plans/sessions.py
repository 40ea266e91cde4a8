"""Composed session queries, each one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.staging import written
from colweave.functions.text import iso_timestamp, trim_ws
from colweave.operators.sessions import (
    access_grants,
    decode_payloads,
    has_real_name,
    owned_sessions,
    session_times,
    shared_sessions,
    user_ids,
    with_display_name,
)
from colweave.schemas import SUGGESTION_LIMIT


def list_sessions(projects: DataFrame, shares: DataFrame, profiles: DataFrame, user_id: str | None = None) -> DataFrame:
    """Sessions of one user, or of all users at once, newest first.

    Owned and shared lists are added up: a session shared with its own owner is listed twice. With a user given, both
    filters reach the scans. For all users the listing is in order of users, then time, by ranges that also split the list
    of a user with very many sessions; it is written first, so that finding the ranges does not repeat its joins.
    """
    owned_from, shared_from = projects, shares
    if user_id is not None:
        owned_from = projects.filter(F.col("owner_user_id") == user_id)
        shared_from = shares.filter(F.col("shared_with_user_id") == user_id)
    listing = owned_sessions(owned_from).unionByName(shared_sessions(projects, shared_from))
    named = with_display_name(listing, profiles, "owner_user_id", "owner_display_name")
    if user_id is not None:
        return session_times(named.orderBy(F.desc("updated_at"), "id"))
    order = ("user_id", F.desc("updated_at"), "id")
    return session_times(written(named, "listing").repartitionByRange(*order).sortWithinPartitions(*order))


def session_payloads(projects: DataFrame, shares: DataFrame, profiles: DataFrame, user_id: str | None = None) -> DataFrame:
    """Sessions with decoded payloads, for one user or for every (session, user) pair that may open one.

    Recipients are a table of their own (`session_shares`), so that a widely shared session is never gathered.
    """
    grants = access_grants(projects, shares)
    if user_id is None:
        # Decoded once per session, before the join multiplies it.
        decoded = decode_payloads(projects).join(grants, "id")
    else:
        mine = projects.join(grants.filter(F.col("user_id") == user_id), "id", "left_semi")
        decoded = decode_payloads(mine).withColumn("user_id", F.lit(user_id))
    decoded = decoded.withColumn("is_owner", F.col("owner_user_id") == F.col("user_id"))
    return session_times(with_display_name(decoded, profiles, "owner_user_id", "owner_display_name"))


def session_shares(shares: DataFrame, profiles: DataFrame, project_ids: DataFrame | None = None) -> DataFrame:
    """Recipients of sessions in the order they were added. `project_ids` (project_id) restricts the sessions."""
    chosen = shares if project_ids is None else shares.join(project_ids, "project_id", "left_semi")
    named = with_display_name(
        chosen.select("project_id", "id", F.col("shared_with_user_id").alias("user_id"), "role", "shared_at"), profiles, "user_id", "display_name"
    )
    ordered = named.orderBy("project_id", "shared_at", "id")
    return ordered.select("project_id", "user_id", "display_name", "role", iso_timestamp(F.col("shared_at")).alias("shared_at"))


def owner_shares(projects: DataFrame, shares: DataFrame, profiles: DataFrame, asks: DataFrame) -> DataFrame:
    """Recipients of the sessions asked for (project_id, user_id); only the owner's asks are answered."""
    owners = projects.select(F.col("id").alias("project_id"), F.col("owner_user_id").alias("user_id"))
    return session_shares(shares, profiles, asks.join(owners, ["project_id", "user_id"], "left_semi").select("project_id"))


def known_users(
    projects: DataFrame, shares: DataFrame, profiles: DataFrame, prefix: str | None = None, limit: int = SUGGESTION_LIMIT
) -> DataFrame:
    """Users with a real name who own or received a session, by name; the name or id may have to start with a prefix.

    The order is by code point; the limit is a top-k, which keeps k rows per task.
    """
    known = profiles.filter(has_real_name()).join(user_ids(projects, shares), "user_id", "left_semi")
    wanted = (prefix or "").strip().lower()
    if wanted:
        starts = lambda c: F.startswith(F.lower(c), F.lit(wanted))
        known = known.filter(starts("display_name") | starts("user_id"))
    return known.select("user_id", "display_name").orderBy("display_name", "user_id").limit(limit)


def known_users_for(
    projects: DataFrame, shares: DataFrame, profiles: DataFrame, asks: DataFrame, limit: int = SUGGESTION_LIMIT
) -> DataFrame:
    """`known_users` for many asks (ask_id, prefix) at once, each with its rank.

    Users are keyed by those beginnings of name and id that have the length of an asked prefix; a key that nobody asks for
    goes before the first users of each are chosen, and the choice starts on the map side.
    """
    known = profiles.filter(has_real_name()).join(user_ids(projects, shares), "user_id", "left_semi").select("user_id", "display_name")
    wanted = asks.select("ask_id", F.lower(trim_ws(F.coalesce("prefix", F.lit("")))).alias("prefix"))
    asked = wanted.select("prefix").distinct()
    lengths = asked.agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    beginnings = lambda text: F.transform(F.filter("lengths", lambda n: n <= F.char_length(text)), lambda n: F.left(text, n))
    keyed = known.withColumn("lengths", lengths.scalar())
    keyed = keyed.select("user_id", "display_name", F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.lower("display_name"), F.lower("user_id")), beginnings)))).alias("prefix"))
    ordered = Window.partitionBy("prefix").orderBy("display_name", "user_id")
    first = keyed.join(asked, "prefix", "left_semi").withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= limit)
    return wanted.join(first, "prefix").select("ask_id", "rank", "user_id", "display_name")
