"""Queries over the session catalogue and its merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from colweave.functions.text import iso_timestamp, session_name, short_user_label
from colweave.operators import merges, sessions
from colweave.plans import sessions as plans
from workloads.standins import table



def now():
    """Time of the merges, fixed so that both sides agree."""
    return F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")


NOW_SQL = "TIMESTAMP '2024-05-06 07:08:09'"


def projects(spark, sf):
    """Orders as sessions; payload texts are valid, malformed, or a JSON null."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    files = F.concat(F.lit('[{"fileName":"f'), key, F.lit('.csv","content":"a,b"}]'))
    files = F.when(F.col("o_orderstatus") == "O", files).when(F.col("o_orderstatus") == "F", F.concat(files, F.lit("]"))).otherwise("null")
    current = F.concat(F.lit('{"global_confidence":0.5,"analysis_summary":"s'), key, F.lit('"}'))
    return o.select(
        key.alias("id"), F.col("o_custkey").cast("string").alias("owner_user_id"), F.concat(F.lit("order "), key).alias("name"),
        files.alias("source_files_json"), F.lit("[]").alias("target_files_json"), F.lit('{"role":"user"}').alias("chat_history_json"),
        F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderstatus") == "O", current).otherwise("{bad")).alias("current_mapping_json"),
        F.lit('[{"name":"r","content":"c"}]').alias("rules_json"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


def shares(spark, sf):
    """Order lines as shares: one per (order, part), with the earliest ship date; users are part keys."""
    li = table(spark, sf, "lineitem")
    pairs = li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_shipdate").alias("shared_at"), F.max("l_returnflag").alias("flag"))
    project, user = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    return pairs.select(
        F.concat_ws("-", project, user).alias("id"), project.alias("project_id"), user.alias("shared_with_user_id"),
        F.when(F.col("flag") == "A", "editor").otherwise("viewer").alias("role"), "shared_at",
    )


def profiles(spark, sf):
    """Customers as profiles; every seventh name is blank, every eleventh is the id."""
    c = table(spark, sf, "customer")
    user = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 11 == 0, user).otherwise(F.col("c_name"))
    return c.select(user.alias("user_id"), name.alias("display_name"), F.lit("2020-01-01").cast("timestamp_ntz").alias("last_updated"))


TABLES = """
projects AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS owner_user_id, 'order ' || o_orderkey AS name, o_orderstatus AS st,
  o_orderdate AS created_at, o_orderdate AS updated_at FROM orders),
shares AS (SELECT l_orderkey || '-' || l_partkey AS id, CAST(l_orderkey AS VARCHAR) AS project_id, CAST(l_partkey AS VARCHAR) AS shared_with_user_id,
  CASE WHEN max(l_returnflag) = 'A' THEN 'editor' ELSE 'viewer' END AS role, min(l_shipdate) AS shared_at FROM lineitem GROUP BY l_orderkey, l_partkey),
profiles AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id,
  CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS display_name, TIMESTAMP '2020-01-01' AS last_updated FROM customer),
listing AS (SELECT owner_user_id AS user_id, id, name, created_at, updated_at, owner_user_id, true AS is_owner FROM projects
  UNION ALL SELECT shared_with_user_id, p.id, name, created_at, updated_at, owner_user_id, false FROM shares s JOIN projects p ON p.id = s.project_id)"""
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '0'"


def _all(spark, sf):
    return projects(spark, sf), shares(spark, sf), profiles(spark, sf)


def s2_session_scan(spark, sf):
    p = projects(spark, sf)
    return p.select("id", "owner_user_id", "name", iso_timestamp(F.col("updated_at")).alias("updated_at"))


S2 = f"WITH {TABLES} SELECT id, owner_user_id, name, {ISO.format('updated_at')} AS updated_at FROM projects"


def s3_payload_decode(spark, sf):
    d = sessions.decode_payloads(projects(spark, sf))
    return d.select(
        "id", F.size("source_files").cast("bigint").alias("n_source"), F.try_element_at("source_files", F.lit(1))["fileName"].alias("first_file"),
        F.size("target_files").cast("bigint").alias("n_target"), F.size("chat_history").cast("bigint").alias("n_chat"),
        F.col("current_mapping").isNotNull().alias("has_mapping"), F.col("current_mapping.analysis_summary").alias("summary"), F.col("rules")[0]["content"].alias("rule"),
    )


S3 = f"""WITH {TABLES} SELECT id, CAST(CASE WHEN st = 'O' THEN 1 ELSE 0 END AS BIGINT) AS n_source, CASE WHEN st = 'O' THEN 'f' || id || '.csv' END AS first_file,
  CAST(0 AS BIGINT) AS n_target, CAST(0 AS BIGINT) AS n_chat, st = 'O' AS has_mapping, CASE WHEN st = 'O' THEN 's' || id END AS summary, 'c' AS rule FROM projects"""


def l1_session_list(spark, sf):
    return plans.list_sessions(*_all(spark, sf))


L1 = f"""WITH {TABLES} SELECT l.user_id, id, name, {ISO.format('created_at')} AS created_at, {ISO.format('l.updated_at')} AS updated_at, owner_user_id, is_owner,
  display_name AS owner_display_name FROM listing l LEFT JOIN profiles p ON p.user_id = owner_user_id"""


def l1_session_list_one_user(spark, sf):
    return plans.list_sessions(*_all(spark, sf), user_id="42")


L1_ONE = f"{L1} WHERE l.user_id = '42'"


def _decoded():
    """Something of every payload, so that all are decoded."""
    return (
        F.size("source_files").cast("bigint").alias("n_source"), F.size("target_files").cast("bigint").alias("n_target"), F.size("chat_history").cast("bigint").alias("n_chat"),
        F.col("current_mapping.analysis_summary").alias("summary"), F.col("rules")[0]["content"].alias("rule"),
    )


def l2_session_payloads(spark, sf):
    d = plans.session_payloads(*_all(spark, sf))
    return d.select("id", "user_id", "is_owner", "owner_display_name", "updated_at", *_decoded())


L2 = f"""WITH {TABLES}, g AS (SELECT id, owner_user_id AS user_id FROM projects UNION SELECT project_id, shared_with_user_id FROM shares)
SELECT p.id, g.user_id, g.user_id = owner_user_id AS is_owner, display_name AS owner_display_name, {ISO.format('updated_at')} AS updated_at,
  CAST(CASE WHEN st = 'O' THEN 1 ELSE 0 END AS BIGINT) AS n_source, CAST(0 AS BIGINT) AS n_target, CAST(0 AS BIGINT) AS n_chat,
  CASE WHEN st = 'O' THEN 's' || p.id END AS summary, 'c' AS rule FROM projects p JOIN g ON g.id = p.id LEFT JOIN profiles o ON o.user_id = owner_user_id"""


def l2_session_payloads_one_user(spark, sf):
    d = plans.session_payloads(*_all(spark, sf), user_id="42")
    return d.select("id", "user_id", "is_owner", "owner_display_name", "updated_at", *_decoded())


L2_ONE = f"{L2} WHERE g.user_id = '42'"


def l2_o2_session_shares(spark, sf):
    _, s, u = _all(spark, sf)
    return plans.session_shares(s, u)


SHARES_SELECT = f"""SELECT project_id, shared_with_user_id AS user_id, display_name, role, {ISO.format('shared_at')} AS shared_at
FROM shares LEFT JOIN profiles ON user_id = shared_with_user_id"""
L2_SHARES = f"WITH {TABLES} {SHARES_SELECT}"


def _asks(spark, sf):
    """Every supplier asks about the orders of its lines, as the user with its key."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("project_id"), F.col("l_suppkey").cast("string").alias("user_id")).distinct()


ASKS = "asks AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS project_id, CAST(l_suppkey AS VARCHAR) AS user_id FROM lineitem)"


def l3_owner_shares(spark, sf):
    return plans.owner_shares(*_all(spark, sf), _asks(spark, sf))


L3 = f"""WITH {TABLES}, {ASKS} {SHARES_SELECT} WHERE project_id IN (SELECT a.project_id FROM asks a JOIN projects p ON p.id = a.project_id AND p.owner_user_id = a.user_id)"""


def l4_known_users(spark, sf):
    return plans.known_users(*_all(spark, sf))


def _known(where: str) -> str:
    return f"""SELECT user_id, display_name FROM profiles WHERE trim(display_name) <> '' AND display_name <> user_id
  AND user_id IN (SELECT owner_user_id FROM projects UNION SELECT shared_with_user_id FROM shares) {where} ORDER BY display_name, user_id LIMIT 30"""


L4 = f"WITH {TABLES} {_known('')}"


def l4_known_users_prefix(spark, sf):
    return plans.known_users(*_all(spark, sf), prefix=" cusTOMER#0000001 ")


L4_PREFIX = f"""WITH {TABLES} {_known("AND (starts_with(lower(display_name), 'customer#0000001') OR starts_with(lower(user_id), 'customer#0000001'))")}"""


def l4_known_users_bulk(spark, sf):
    """Beginnings of names and ids typed by every third customer."""
    c = table(spark, sf, "customer").filter("c_custkey % 3 = 0")
    key = F.col("c_custkey")
    typed = F.when(key % 2 == 0, F.upper(F.left("c_name", 9 + (key % 10).cast("int")))).otherwise(F.concat(F.lit(" "), F.left(key.cast("string"), F.lit(2))))
    asks = c.select(key.alias("ask_id"), F.when(key % 5 != 0, typed).otherwise(" ").alias("prefix"))
    found = plans.known_users_for(*_all(spark, sf), asks)
    return found.select("ask_id", F.col("rank").cast("bigint").alias("rank"), "user_id", "display_name")


L4_BULK = f"""WITH {TABLES}, k AS (SELECT user_id, display_name FROM profiles WHERE trim(display_name) <> '' AND display_name <> user_id
  AND user_id IN (SELECT owner_user_id FROM projects UNION SELECT shared_with_user_id FROM shares)),
asks AS (SELECT c_custkey AS ask_id, lower(trim(CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN left(c_name, 9 + c_custkey % 10) ELSE left(CAST(c_custkey AS VARCHAR), 2) END)) AS prefix
  FROM customer WHERE c_custkey % 3 = 0)
SELECT ask_id, row_number() OVER (PARTITION BY ask_id ORDER BY display_name, user_id) AS rank, user_id, display_name
FROM asks JOIN k ON starts_with(lower(display_name), prefix) OR starts_with(lower(user_id), prefix) QUALIFY rank <= 30"""


def j1_shared_projects(spark, sf):
    p, s, _ = _all(spark, sf)
    return sessions.shared_sessions(p, s).select("user_id", "id", "name", "is_owner")


J1 = f"WITH {TABLES} SELECT shared_with_user_id AS user_id, p.id, name, false AS is_owner FROM shares s JOIN projects p ON p.id = s.project_id"


def j2_owner_names(spark, sf):
    p, _, u = _all(spark, sf)
    return sessions.with_display_name(p.select("id", "owner_user_id"), u, "owner_user_id", "owner_display_name")


J2 = f"WITH {TABLES} SELECT id, owner_user_id, display_name AS owner_display_name FROM projects LEFT JOIN profiles ON user_id = owner_user_id"


def j3_visible_sessions(spark, sf):
    """Per user, the number of sessions that user may open."""
    p, s, _ = _all(spark, sf)
    return sessions.access_grants(p, s).groupBy("user_id").agg(F.count("*").alias("n_visible"))


J3 = f"""WITH {TABLES} SELECT user_id, count(*) AS n_visible FROM (SELECT owner_user_id AS user_id, id FROM projects UNION SELECT shared_with_user_id, project_id FROM shares) GROUP BY 1"""


def j4_u2_q1_known_profiles(spark, sf):
    p, s, u = _all(spark, sf)
    return u.join(sessions.user_ids(p, s), "user_id", "left_semi").select("user_id", "display_name")


J4 = f"WITH {TABLES} SELECT user_id, display_name FROM profiles WHERE user_id IN (SELECT owner_user_id FROM projects UNION SELECT shared_with_user_id FROM shares)"


def j5_new_grants(spark, sf):
    """Pairs of order and supplier that are not shares yet."""
    wanted = _asks(spark, sf).withColumnRenamed("user_id", "shared_with_user_id")
    return sessions.new_grants(wanted, shares(spark, sf))


J5 = f"""WITH {TABLES}, {ASKS} SELECT project_id, user_id AS shared_with_user_id FROM asks a
WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.project_id = a.project_id AND s.shared_with_user_id = a.user_id)"""


def j6_share_suggestions(spark, sf):
    """Suggestions for the owner of every session."""
    p, s, u = _all(spark, sf)
    asks = p.select(F.col("id").alias("project_id"), F.col("owner_user_id").alias("user_id"))
    found = sessions.share_suggestions(plans.known_users(p, s, u), s, asks)
    return found.groupBy("project_id").agg(F.count("*").alias("n"), F.min("shared_with_user_id").alias("first_user"))


J6 = f"""WITH {TABLES}, k AS ({_known('')}), c AS (SELECT p.id AS project_id, k.user_id AS u FROM projects p JOIN k ON k.user_id <> p.owner_user_id)
SELECT project_id, count(*) AS n, min(u) AS first_user FROM c
WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.project_id = c.project_id AND s.shared_with_user_id = c.u) GROUP BY 1"""


def j7_unread_shared(spark, sf):
    """Sessions count as opened where the share is an editor's."""
    p, s, u = _all(spark, sf)
    opened = s.filter(F.col("role") == "editor").select(F.col("shared_with_user_id").alias("user_id"), F.col("project_id").alias("id"))
    listing = sessions.owned_sessions(p).unionByName(sessions.shared_sessions(p, s))
    return sessions.unread_shared(listing, opened)


J7 = f"""WITH {TABLES} SELECT shared_with_user_id AS user_id, count(*) AS n_unread FROM shares JOIN projects p ON p.id = project_id WHERE role <> 'editor' GROUP BY 1"""


def j8_editor_grants(spark, sf):
    p, s, _ = _all(spark, sf)
    return sessions.access_grants(p, s, role="editor")


J8 = f"WITH {TABLES} SELECT id, owner_user_id AS user_id FROM projects UNION SELECT project_id, shared_with_user_id FROM shares WHERE role = 'editor'"


def o1_newest_first(spark, sf):
    """All sessions, newest first."""
    p = projects(spark, sf)
    return p.orderBy(F.desc("updated_at"), "id").select("id", iso_timestamp(F.col("updated_at")).alias("updated_at"))


O1 = f"WITH {TABLES} SELECT id, {ISO.format('updated_at')} AS updated_at FROM projects ORDER BY projects.updated_at DESC, id"


def o4_first_session(spark, sf):
    return sessions.first_session(projects(spark, sf), "7").select("id", "name")


O4 = f"WITH {TABLES} SELECT id, name FROM projects WHERE id = '7' LIMIT 1"


def q2_existence(spark, sf):
    return sessions.session_exists(projects(spark, sf), F.col("owner_user_id") == "42")


Q2 = f"""WITH {TABLES} SELECT count(*) > 0 AS "exists" FROM projects WHERE owner_user_id = '42'"""


def u1_union_all(spark, sf):
    p, s, _ = _all(spark, sf)
    listing = sessions.owned_sessions(p).unionByName(sessions.shared_sessions(p, s))
    return listing.groupBy("user_id", "id").agg(F.count("*").alias("n_listed"))


U1 = f"WITH {TABLES} SELECT user_id, id, count(*) AS n_listed FROM listing GROUP BY ALL"


def w1_insert_sessions(spark, sf):
    """One new session per supplier, some unnamed."""
    s = table(spark, sf, "supplier")
    created = s.select(
        F.col("s_suppkey").cast("string").alias("owner_user_id"), F.col("s_suppkey").alias("seq"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("  "), "s_name")).otherwise("  ").alias("name"),
        F.lit(None).cast("string").alias("source_files_json"), F.lit("[1]").alias("target_files_json"), F.lit(None).cast("string").alias("chat_history_json"),
        F.lit(None).cast("string").alias("rules_json"), F.lit(None).cast("string").alias("current_mapping_json"),
    )
    merged = merges.insert_sessions(projects(spark, sf), created, now())
    return merged.select("owner_user_id", "name", "id", "source_files_json", "target_files_json", iso_timestamp(F.col("created_at")).alias("created_at"))


PAYLOAD_SQL = """CASE st WHEN 'O' THEN '[{"fileName":"f' || id || '.csv","content":"a,b"}]' WHEN 'F' THEN '[{"fileName":"f' || id || '.csv","content":"a,b"}]]' ELSE 'null' END"""
CURRENT_SQL = """CASE st WHEN 'O' THEN '{"global_confidence":0.5,"analysis_summary":"s' || id || '"}' WHEN 'F' THEN '{bad' END"""
HASH = f"md5(s_suppkey || chr(31) || s_suppkey || chr(31) || epoch_us({NOW_SQL}))"
NEW_ID = f"concat_ws('-', {HASH}[1:8], {HASH}[9:12], {HASH}[13:16], {HASH}[17:20], {HASH}[21:32])"
W1 = f"""WITH {TABLES} SELECT owner_user_id, name, id, {PAYLOAD_SQL} AS source_files_json, '[]' AS target_files_json, {ISO.format('created_at')} AS created_at FROM projects
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE 'Session 2024-05-06 07:08' END, {NEW_ID}, '[]', '[1]', {ISO.format(NOW_SQL)} FROM supplier"""


PATCHES = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
patches AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE l_partkey END AS VARCHAR) AS user_id,
  l_linenumber * 1000000 + l_partkey AS seq, CASE WHEN l_linestatus = 'F' THEN 'n' || l_linenumber END AS name, CASE WHEN l_quantity > 25 THEN '[' || l_linenumber || ']' END AS files,
  CASE WHEN l_quantity <= 25 THEN '[t' || l_linenumber || ']' END AS targets, CASE WHEN l_tax > 0.02 THEN '[c' || l_linenumber || ']' END AS chat,
  CASE WHEN l_linestatus = 'O' THEN '[r' || l_linenumber || ']' END AS rules,
  CASE WHEN l_tax > 0.04 THEN 'm' || l_linenumber END AS current_mapping FROM lines),
ok AS (SELECT pa.* FROM patches pa JOIN projects p ON p.id = pa.id WHERE pa.user_id = p.owner_user_id
  OR EXISTS (SELECT 1 FROM shares s WHERE s.project_id = pa.id AND s.shared_with_user_id = pa.user_id AND s.role = 'editor')),
latest AS (SELECT id, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name, arg_max(files, seq) FILTER (WHERE files IS NOT NULL) AS files,
  arg_max(targets, seq) FILTER (WHERE targets IS NOT NULL) AS targets, arg_max(chat, seq) FILTER (WHERE chat IS NOT NULL) AS chat, arg_max(rules, seq) FILTER (WHERE rules IS NOT NULL) AS rules,
  arg_max(coalesce(current_mapping, '~'), seq) AS current_mapping FROM ok GROUP BY id)"""


def w2_patch_sessions(spark, sf):
    p, s, _ = _all(spark, sf)
    merged = merges.patch_sessions(p, s, _patches(spark, sf), now())
    return merged.select("id", "name", "source_files_json", "target_files_json", "chat_history_json", "rules_json", "current_mapping_json", iso_timestamp(F.col("updated_at")).alias("updated_at"))


def _patches(spark, sf):
    """Order lines as patches, one per (session, seq). The line's part key is the user, so editors and strangers occur;
    the seventh line is patched by its supplier, which may be the owner."""
    raw = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_quantity").alias("l_quantity"), F.min("l_tax").alias("l_tax")
    )
    line = F.col("l_linenumber").cast("string")
    return raw.select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("string").alias("user_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit(" n"), line)).alias("name"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("["), line, F.lit("]"))).alias("source_files_json"), F.when(F.col("l_quantity") <= 25, F.concat(F.lit("[t"), line, F.lit("]"))).alias("target_files_json"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("[c"), line, F.lit("]"))).alias("chat_history_json"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("[r"), line, F.lit("]"))).alias("rules_json"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("m"), line)).alias("current_mapping_json"),
    )


W2 = f"""WITH {TABLES}, {PATCHES}
SELECT p.id, coalesce(l.name, p.name) AS name, coalesce(l.files, {PAYLOAD_SQL.replace("|| id ||", "|| p.id ||")}) AS source_files_json,
  coalesce(l.targets, '[]') AS target_files_json, coalesce(l.chat, '{{"role":"user"}}') AS chat_history_json, coalesce(l.rules, '[{{"name":"r","content":"c"}}]') AS rules_json,
  CASE WHEN l.id IS NULL THEN {CURRENT_SQL.replace("|| id ||", "|| p.id ||")} ELSE nullif(l.current_mapping, '~') END AS current_mapping_json,
  {ISO.format(f"CASE WHEN l.id IS NULL THEN p.updated_at ELSE {NOW_SQL} END")} AS updated_at FROM projects p LEFT JOIN latest l ON l.id = p.id"""


def w2_patch_outcomes(spark, sf):
    p, s, _ = _all(spark, sf)
    return merges.patch_outcomes(p, s, _patches(spark, sf))


W2_OUT = f"WITH {TABLES}, {PATCHES} SELECT DISTINCT id, user_id, true AS is_owner FROM ok"


def _deletes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_suppkey").cast("string").alias("user_id"))


GONE = "gone AS (SELECT p.id FROM projects p WHERE EXISTS (SELECT 1 FROM asks a WHERE a.project_id = p.id AND a.user_id = p.owner_user_id))"


def w3_delete_sessions(spark, sf):
    p, s, _ = _all(spark, sf)
    left, _ = merges.delete_sessions(p, s, _deletes(spark, sf))
    return left.select("id", "owner_user_id")


W3 = f"WITH {TABLES}, {ASKS}, {GONE} SELECT id, owner_user_id FROM projects WHERE id NOT IN (SELECT id FROM gone)"


def w3_delete_cascade(spark, sf):
    p, s, _ = _all(spark, sf)
    _, left = merges.delete_sessions(p, s, _deletes(spark, sf))
    return left.select("project_id", "shared_with_user_id")


W3_SHARES = f"WITH {TABLES}, {ASKS}, {GONE} SELECT project_id, shared_with_user_id FROM shares WHERE project_id NOT IN (SELECT id FROM gone)"


def _share_requests(spark, sf):
    """Every owner shares each session with the user after them, a blank, and a padded id; roles by status."""
    o = table(spark, sf, "orders")
    nxt = (F.col("o_custkey") + 1).cast("string")
    return o.select(
        F.col("o_orderkey").cast("string").alias("project_id"), F.when(F.col("o_orderstatus") == "P", F.lit("-1")).otherwise(F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_orderkey").alias("seq"), F.array(nxt, F.lit(" "), F.concat(F.lit(" x"), nxt, F.lit(" "))).alias("shared_with_user_ids"),
        F.when(F.col("o_orderstatus") == "O", F.lit(" editor ")).otherwise(F.lit(" ")).alias("role"),
        F.create_map(nxt, F.concat(F.lit(" named "), F.col("o_orderkey").cast("string"))).alias("display_names"),
    )


ADDED = """added AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS project_id, unnest([CAST(o_custkey + 1 AS VARCHAR), 'x' || (o_custkey + 1)]) AS u,
  CASE WHEN o_orderstatus = 'O' THEN 'editor' ELSE 'viewer' END AS role FROM orders WHERE o_orderstatus <> 'P')"""


def w4_add_shares(spark, sf):
    new, _ = merges.add_shares(*_all(spark, sf), _share_requests(spark, sf), now())
    return new.select("project_id", "shared_with_user_id", "role", iso_timestamp(F.col("shared_at")).alias("shared_at"))


W4 = f"""WITH {TABLES}, {ADDED} SELECT project_id, shared_with_user_id, role, {ISO.format('shared_at')} AS shared_at FROM shares
UNION ALL SELECT project_id, u, role, {ISO.format(NOW_SQL)} FROM added a WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.project_id = a.project_id AND s.shared_with_user_id = a.u)"""


def w4_share_names(spark, sf):
    _, named = merges.add_shares(*_all(spark, sf), _share_requests(spark, sf), now())
    return named.select("user_id", "display_name", iso_timestamp(F.col("last_updated")).alias("last_updated"))


W4_NAMES = f"""WITH {TABLES}, n AS (SELECT CAST(o_custkey + 1 AS VARCHAR) AS user_id, 'named ' || max(o_orderkey) AS name FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(n.user_id, p.user_id) AS user_id, coalesce(name, display_name) AS display_name,
  {ISO.format(f"CASE WHEN n.user_id IS NULL THEN last_updated ELSE {NOW_SQL} END")} AS last_updated FROM profiles p FULL JOIN n ON n.user_id = p.user_id"""


def w5_remove_shares(spark, sf):
    """Owners remove the shares of the parts they ordered; strangers' requests change nothing."""
    p, s, _ = _all(spark, sf)
    li = table(spark, sf, "lineitem")
    requests = li.select(
        F.col("l_orderkey").cast("string").alias("project_id"), F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("shared_with_user_id")
    )
    return merges.remove_shares(p, s, requests).select("project_id", "shared_with_user_id", "role")


W5 = f"""WITH {TABLES}, r AS (SELECT CAST(l_orderkey AS VARCHAR) AS project_id, CAST(l_suppkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS u FROM lineitem)
SELECT project_id, shared_with_user_id, role FROM shares s
WHERE NOT EXISTS (SELECT 1 FROM r JOIN projects p ON p.id = r.project_id AND p.owner_user_id = r.user_id WHERE r.project_id = s.project_id AND r.u = s.shared_with_user_id)"""


def w6_upsert_profiles(spark, sf):
    """Suppliers report names for the users with their keys, and for new ones."""
    s = table(spark, sf, "supplier")
    name = F.when(F.col("s_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name"))
    changes = s.select(F.col("s_suppkey").cast("string").alias("user_id"), name.alias("display_name"), F.lit(1).alias("seq"))
    fresh = s.select(F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("user_id"), name.alias("display_name"), F.lit(1).alias("seq"))
    blank = s.select(F.lit(" ").alias("user_id"), F.lit("nobody").alias("display_name"), F.lit(1).alias("seq"))
    merged = merges.upsert_profiles(profiles(spark, sf), changes.union(fresh).union(blank), now())
    return merged.select("user_id", "display_name", iso_timestamp(F.col("last_updated")).alias("last_updated"))


W6 = f"""WITH {TABLES}, c AS (SELECT CAST(s_suppkey AS VARCHAR) AS user_id, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END AS name FROM supplier
  UNION ALL SELECT 'new' || s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END FROM supplier)
SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(name, display_name, c.user_id) AS display_name,
  {ISO.format(f"CASE WHEN c.user_id IS NULL THEN last_updated ELSE {NOW_SQL} END")} AS last_updated FROM profiles p FULL JOIN c ON c.user_id = p.user_id"""


def f1_user_labels(spark, sf):
    """Short labels of users whose ids are long."""
    user = F.concat(F.lit("user-"), F.lpad(F.col("user_id"), 8, "0"))
    u = profiles(spark, sf)
    return u.select(user.alias("long_id"), short_user_label(user, F.col("display_name")).alias("label"), short_user_label(F.col("user_id"), F.lit(None)).alias("short"))


F1 = f"""WITH {TABLES}, l AS (SELECT *, 'user-' || lpad(user_id, 8, '0') AS long_id FROM profiles)
SELECT long_id, CASE WHEN trim(display_name) <> '' THEN trim(display_name) ELSE 'User ' || left(long_id, 8) || '…' END AS label, user_id AS short FROM l"""


def f2_session_names(spark, sf):
    return table(spark, sf, "events").select("event_id", session_name(F.col("ts")).alias("name"), iso_timestamp(F.col("ts")).alias("iso"))


F2 = f"SELECT event_id, 'Session ' || strftime(ts, '%Y-%m-%d %H:%M') AS name, {ISO.format('ts')} AS iso FROM events"

QUERIES = {
    "s2_session_scan": (s2_session_scan, S2),
    "s3_payload_decode": (s3_payload_decode, S3),
    "l1_session_list": (l1_session_list, L1),
    "l1_session_list_one_user": (l1_session_list_one_user, L1_ONE),
    "l2_session_payloads": (l2_session_payloads, L2),
    "l2_session_payloads_one_user": (l2_session_payloads_one_user, L2_ONE),
    "l2_o2_session_shares": (l2_o2_session_shares, L2_SHARES),
    "l3_owner_shares": (l3_owner_shares, L3),
    "l4_o3_known_users": (l4_known_users, L4),
    "l4_known_users_prefix": (l4_known_users_prefix, L4_PREFIX),
    "l4_known_users_bulk": (l4_known_users_bulk, L4_BULK),
    "j1_shared_projects": (j1_shared_projects, J1),
    "j2_owner_names": (j2_owner_names, J2),
    "j3_visible_sessions": (j3_visible_sessions, J3),
    "j4_u2_q1_known_profiles": (j4_u2_q1_known_profiles, J4),
    "j5_new_grants": (j5_new_grants, J5),
    "j6_share_suggestions": (j6_share_suggestions, J6),
    "j7_unread_shared": (j7_unread_shared, J7),
    "j8_editor_grants": (j8_editor_grants, J8),
    "o1_newest_first": (o1_newest_first, O1),
    "o4_first_session": (o4_first_session, O4),
    "q2_existence": (q2_existence, Q2),
    "u1_union_all": (u1_union_all, U1),
    "w1_insert_sessions": (w1_insert_sessions, W1),
    "w2_patch_sessions": (w2_patch_sessions, W2),
    "w2_patch_outcomes": (w2_patch_outcomes, W2_OUT),
    "w3_delete_sessions": (w3_delete_sessions, W3),
    "w3_delete_cascade": (w3_delete_cascade, W3_SHARES),
    "w4_add_shares": (w4_add_shares, W4),
    "w4_share_names": (w4_share_names, W4_NAMES),
    "w5_remove_shares": (w5_remove_shares, W5),
    "w6_upsert_profiles": (w6_upsert_profiles, W6),
    "f1_user_labels": (f1_user_labels, F1),
    "f2_session_names": (f2_session_names, F2),
}
