"""Batch merges of change tables into the session tables.

Each merge computes the new version of a table; write it beside the old one. Several changes to one row have the
effect of applying them in `seq` order, found with aggregates that combine on the map side. Times and ids are inputs
or derived from inputs, never drawn, so a task that runs again after a lost executor produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.staging import written
from colweave.functions.text import is_blank, null_if_blank, session_name, trim_ws
from colweave.operators.sessions import access_grants

LIST_PAYLOADS = ("source_files_json", "target_files_json", "chat_history_json", "rules_json")


def derived_id(*parts: str) -> Column:
    """A UUID-shaped id from a hash of columns that identify the row."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def _last(value: Column, seq: str = "seq") -> Column:
    """Last non-null value in sequence order."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col(seq).alias("seq"), value.alias("value"))))["value"]


def insert_sessions(projects: DataFrame, created: DataFrame, now: Column) -> DataFrame:
    """Add sessions: blank names get a default, missing lists are empty.

    `created` has unique (owner_user_id, seq) within a batch, and `now` tells batches apart. A session whose id is already
    there, as after a repeated batch, is not added again.
    """
    rows = created.select(
        derived_id("owner_user_id", "seq", F.unix_micros(now.cast("timestamp"))).alias("id"),
        "owner_user_id",
        F.coalesce(null_if_blank(F.col("name")), session_name(now)).alias("name"),
        *[F.coalesce(F.col(c), F.lit("[]")).alias(c) for c in LIST_PAYLOADS],
        "current_mapping_json",
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return projects.unionByName(rows.join(projects.select("id"), "id", "left_anti"))


def patch_sessions(projects: DataFrame, shares: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Patch sessions on behalf of their owner or an editor; other patches are ignored.

    A null field keeps the old value, except the current mapping: the last patch sets it, and null clears it. First the
    number of the patch that wins each field is found, then the texts of the winning patches are fetched, which are at
    most one for each field; allowed patches are written once for both.
    """
    allowed = written(patches.join(access_grants(projects, shares, role="editor"), ["id", "user_id"], "left_semi"), "patches")
    fields = ("name", *LIST_PAYLOADS)
    wins = [F.max(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"seq_{c}") for c in fields]
    latest = allowed.groupBy("id").agg(F.max("seq").alias("patched"), *wins)
    winning = F.array("patched", *[f"seq_{c}" for c in fields])
    texts = allowed.select("id", "seq", *fields, "current_mapping_json").join(latest.select("id", winning.alias("winning")), "id")
    texts = texts.filter(F.array_contains("winning", F.col("seq"))).groupBy("id").agg(F.collect_list(F.struct("seq", *fields, "current_mapping_json")).alias("texts"))
    joined = projects.join(latest.join(texts, "id"), "id", "left")

    def new(c: str, seq: str) -> Column:
        return F.array_max(F.transform(F.filter("texts", lambda t: t["seq"] == F.col(seq)), lambda t: t[c]))

    patched = F.col("patched").isNotNull()
    change = {
        "name": F.coalesce(trim_ws(new("name", "seq_name")), F.col("name")),
        "current_mapping_json": F.when(patched, new("current_mapping_json", "patched")).otherwise(F.col("current_mapping_json")),
        "updated_at": F.when(patched, now).otherwise(F.col("updated_at")),
        **{c: F.coalesce(new(c, f"seq_{c}"), F.col(c)) for c in LIST_PAYLOADS},
    }
    return joined.select(*[change[c].alias(c) if c in change else F.col(c) for c in projects.columns])


def patch_outcomes(projects: DataFrame, shares: DataFrame, patches: DataFrame) -> DataFrame:
    """Sessions that took a patch, as the answer reports them: always marked as owned, for editors too."""
    allowed = patches.join(access_grants(projects, shares, role="editor"), ["id", "user_id"], "left_semi")
    return allowed.select("id", "user_id", F.lit(True).alias("is_owner")).distinct()


def delete_sessions(projects: DataFrame, shares: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove sessions on behalf of their owner, and the shares of those sessions."""
    owners = projects.select("id", F.col("owner_user_id").alias("user_id"))
    gone = deletes.join(owners, ["id", "user_id"], "left_semi").select("id").distinct()
    return projects.join(gone, "id", "left_anti"), shares.join(gone.withColumnRenamed("id", "project_id"), "project_id", "left_anti")


def _owned_requests(projects: DataFrame, requests: DataFrame) -> DataFrame:
    owners = projects.select(F.col("id").alias("project_id"), F.col("owner_user_id").alias("user_id"))
    return requests.join(owners, ["project_id", "user_id"], "left_semi")


def add_shares(projects: DataFrame, shares: DataFrame, profiles: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Share sessions with lists of users, on behalf of the owner; returns new shares and profiles.

    `requests`: project_id, user_id (asking), seq, shared_with_user_ids, role, display_names (map, optional names).
    Blank ids are skipped, an existing pair keeps its role, a blank role means viewer. Names given for recipients are
    merged into the profiles.
    """
    each = _owned_requests(projects, requests).select("project_id", "seq", "role", "display_names", F.explode("shared_with_user_ids").alias("raw_id"))
    each = each.filter(~is_blank(F.col("raw_id"))).withColumn("shared_with_user_id", trim_ws(F.col("raw_id")))
    # The first request for a pair decides its role.
    first = each.groupBy("project_id", "shared_with_user_id").agg(F.min(F.struct("seq", "role")).alias("first"))
    existing = shares.select("project_id", "shared_with_user_id")
    added = first.join(existing, ["project_id", "shared_with_user_id"], "left_anti").select(
        derived_id("project_id", "shared_with_user_id").alias("id"),
        "project_id",
        "shared_with_user_id",
        F.coalesce(null_if_blank(F.col("first.role")), F.lit("viewer")).alias("role"),
        now.alias("shared_at"),
    )
    given = F.try_element_at("display_names", F.col("shared_with_user_id"))
    named = each.select(F.col("shared_with_user_id").alias("user_id"), given.alias("display_name"), "seq").filter(~is_blank(F.col("display_name")))
    return shares.unionByName(added), upsert_profiles(profiles, named, now)


def remove_shares(projects: DataFrame, shares: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove (project_id, shared_with_user_id) pairs on behalf of the owner (user_id)."""
    gone = _owned_requests(projects, requests).select("project_id", "shared_with_user_id")
    return shares.join(gone, ["project_id", "shared_with_user_id"], "left_anti")


def upsert_profiles(profiles: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """New users get their name, or their id without one; known users change name only where one is given."""
    latest = (
        changes.filter(~is_blank(F.col("user_id")))
        .groupBy("user_id")
        .agg(_last(null_if_blank(F.col("display_name"))).alias("new_name"), F.lit(True).alias("changed"))
    )
    joined = profiles.withColumnRenamed("display_name", "old_name").join(latest, "user_id", "full_outer")
    return joined.select(
        "user_id",
        F.coalesce("new_name", "old_name", "user_id").alias("display_name"),
        F.when(F.col("changed"), now).otherwise(F.col("last_updated")).alias("last_updated"),
    )
