import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import matching, merges, sessions
from colweave.plans import sessions as plans
from colweave.streaming import chunks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    cols = "id string, owner_user_id string, name string, source_files_json string, target_files_json string, chat_history_json string, current_mapping_json string, rules_json string, created_at timestamp_ntz, updated_at timestamp_ntz"
    projects = spark.createDataFrame(
        [("p1", "ann", "one", '[{"fileName":"f","content":"c"}]', "{bad", "[]", '{"global_confidence":0.5}', "null", T0, T0), ("p2", "bob", "two", "[]", "[]", "[]", "7", "[]", T0, T0 + dt.timedelta(days=1))], cols
    )
    shares = spark.createDataFrame(
        [("s1", "p1", "ann", "viewer", T0), ("s2", "p1", "eve", "editor", T0), ("s3", "p2", "ann", "viewer", T0)], "id string, project_id string, shared_with_user_id string, role string, shared_at timestamp_ntz"
    )
    profiles = spark.createDataFrame([("ann", "Ann", T0), ("bob", " ", T0), ("eve", "eve", T0)], "user_id string, display_name string, last_updated timestamp_ntz")
    return projects, shares, profiles


NOW = "2024-02-03 04:05:06"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_a_session_shared_with_its_owner_is_listed_twice(tables):
    listed = plans.list_sessions(*tables, user_id="ann").collect()
    assert [(r["id"], r["is_owner"]) for r in listed][0] == ("p2", False)
    assert sorted((r["id"], r["is_owner"]) for r in listed) == [("p1", False), ("p1", True), ("p2", False)]
    assert {r["owner_display_name"] for r in listed} == {"Ann", " "}
    assert listed[0]["updated_at"] == "2024-01-02T00:00:00.0000000"


def test_malformed_payloads_give_defaults(tables):
    rows = {r["id"]: r for r in sessions.decode_payloads(tables[0]).collect()}
    assert rows["p1"]["source_files"][0]["fileName"] == "f" and rows["p1"]["target_files"] == [] and rows["p1"]["rules"] == []
    assert rows["p1"]["current_mapping"]["global_confidence"] == 0.5 and rows["p2"]["current_mapping"] is None


def test_known_users_need_a_real_name(tables):
    assert [r["user_id"] for r in plans.known_users(*tables).collect()] == ["ann"]
    assert plans.known_users(*tables, prefix="x").count() == 0


def test_known_users_for_many_asks_equal_one_by_one(spark, tables):
    projects, shares, _ = tables
    names = [("ann", "Ann"), ("bob", "anna"), ("eve", "Bert"), ("kim", "kim"), ("zoe", "Éva")]
    profiles = spark.createDataFrame([(u, n, T0) for u, n in names], "user_id string, display_name string, last_updated timestamp_ntz")
    shares = shares.union(spark.createDataFrame([("s9", "p1", "zoe", "viewer", T0), ("s8", "p1", "kim", "viewer", T0)], shares.schema))
    prefixes = ["", None, " A", "ann", "anna", "annas", "b", "E", "é", "kim", "bo"]
    asks = spark.createDataFrame(list(enumerate(prefixes)), "ask_id int, prefix string")
    got = sorted(map(tuple, plans.known_users_for(projects, shares, profiles, asks, limit=2).collect()))
    want = sorted((i, k, r["user_id"], r["display_name"]) for i, p in enumerate(prefixes) for k, r in enumerate(plans.known_users(projects, shares, profiles, p, 2).collect(), 1))
    assert got == want


def patches(spark, *rows):
    cols = ("id", "user_id", "seq", "name", "source_files_json", "target_files_json", "chat_history_json", "current_mapping_json", "rules_json")
    schema = ", ".join(f"{c} {'int' if c == 'seq' else 'string'}" for c in cols)
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)


def test_patch_clears_the_mapping_and_keeps_the_rest(spark, tables):
    projects, shares, _ = tables
    changes = patches(
        spark, dict(id="p1", user_id="eve", seq=1, name=" new ", current_mapping_json="{}"), dict(id="p1", user_id="ann", seq=2, rules_json="[1]"), dict(id="p2", user_id="ann", seq=3, name="stolen")
    )
    rows = {r["id"]: r for r in merges.patch_sessions(projects, shares, changes, now()).collect()}
    assert (rows["p1"]["name"], rows["p1"]["rules_json"], rows["p1"]["current_mapping_json"], rows["p1"]["target_files_json"]) == ("new", "[1]", None, "{bad")
    assert str(rows["p1"]["updated_at"]) == NOW and rows["p2"]["name"] == "two" and rows["p2"]["updated_at"] != rows["p1"]["updated_at"]
    assert {(r["id"], r["user_id"], r["is_owner"]) for r in merges.patch_outcomes(projects, shares, changes).collect()} == {("p1", "eve", True), ("p1", "ann", True)}


def test_delete_cascades_for_owners_only(spark, tables):
    projects, shares, _ = tables
    deletes = spark.createDataFrame([("p1", "ann"), ("p2", "ann")], "id string, user_id string")
    left, kept = merges.delete_sessions(projects, shares, deletes)
    assert [r["id"] for r in left.collect()] == ["p2"] and [r["id"] for r in kept.collect()] == ["s3"]


def test_shares_and_profiles(spark, tables):
    projects, shares, profiles = tables
    requests = spark.createDataFrame(
        [("p1", "ann", 1, [" eve", " ", "kim", "kim "], " ", {"kim": "Kim"}), ("p2", "ann", 2, ["zed"], "editor", None)],
        "project_id string, user_id string, seq int, shared_with_user_ids array<string>, role string, display_names map<string,string>",
    )
    new, named = merges.add_shares(projects, shares, profiles, requests, now())
    assert {(r["project_id"], r["shared_with_user_id"], r["role"]) for r in new.collect()} == {("p1", "ann", "viewer"), ("p1", "eve", "editor"), ("p2", "ann", "viewer"), ("p1", "kim", "viewer")}
    assert {r["user_id"]: r["display_name"] for r in named.collect()} == {"ann": "Ann", "bob": " ", "eve": "eve", "kim": "Kim"}
    gone = merges.remove_shares(projects, shares, spark.createDataFrame([("p1", "ann", "eve"), ("p2", "ann", "ann")], "project_id string, user_id string, shared_with_user_id string"))
    assert sorted(r["id"] for r in gone.collect()) == ["s1", "s3"]


def test_profile_upserts(spark, tables):
    changes = spark.createDataFrame([("ann", " Anna ", 1), ("ann", " ", 2), ("new", None, 1), (" ", "x", 1), ("eve", None, 1)], "user_id string, display_name string, seq int")
    rows = {r["user_id"]: (r["display_name"], str(r["last_updated"]) == NOW) for r in merges.upsert_profiles(tables[2], changes, now()).collect()}
    assert rows == {"ann": ("Anna", True), "bob": (" ", False), "eve": ("eve", True), "new": ("new", True)}


def test_inserts_are_repeatable(spark, tables):
    created = spark.createDataFrame([("ann", 1, "  ", None), ("ann", 2, " x ", "[1]")], "owner_user_id string, seq int, name string, rules_json string")
    for c in ("source_files_json", "target_files_json", "chat_history_json", "current_mapping_json"):
        created = created.withColumn(c, F.lit(None).cast("string"))
    merged = merges.insert_sessions(tables[0], created, now())
    rows = sorted((r["name"], r["rules_json"], r["id"]) for r in merged.filter(F.col("created_at") == now()).collect())
    assert [r[:2] for r in rows] == [("Session 2024-02-03 04:05", "[]"), ("x", "[1]")]
    assert rows == sorted((r["name"], r["rules_json"], r["id"]) for r in merged.filter(F.col("created_at") == now()).collect())


# --- matching -----------------------------------------------------------------------------------------------------


def catalog(spark, *rows):
    return spark.createDataFrame([("0", *r) for r in rows], "request_id string, side string, table_name string, column_name string, data_type string")


def by_target(df):
    return {r["target_column"]: r for r in df.collect()}


def test_match_types(spark):
    got = by_target(
        matching.match_columns(
            catalog(
                spark, ("source", "s", "email", "varchar"), ("source", "s", "city", "text"), ("source", "s", "zipCode", "int"), ("source", "s", "created_at", "varchar"), ("source", "s", "price", "decimal"), ("source", "s", "dob", "date"),
                ("target", "t", "Email", "string"), ("target", "t", "city_zip_code", "string"), ("target", "t", "created_at", "datetime"), ("target", "t", "unit_price", "double"), ("target", "t", "nothing", "int"), ("target", "t", "birth_date", "date"),
            ),
            spark.createDataFrame([("DOB", "birth_date")], "name string, canonical string"),
        )
    )
    shape = {k: (v["source_columns"], v["match_type"], v["transformation_rule"]) for k, v in got.items()}
    assert shape == {
        "t.Email": (["s.email"], "exact", None),
        "t.city_zip_code": (["s.city", "s.zipCode"], "derived", "CONCAT_WS(' ', s.city, s.zipCode)"),
        "t.created_at": (["s.created_at"], "transformed", "CAST(s.created_at AS TIMESTAMP)"),
        "t.unit_price": (["s.price"], "semantic", None),
        "t.nothing": ([], "incompatible", None),
        "t.birth_date": (["s.dob"], "exact", None),
    }
    assert all(0 <= v["confidence_score"] <= 1 for v in got.values())


def longest_run(a, b):
    return max((k for k in range(1, min(len(a), len(b)) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def name_score(a, b):
    """The definition, for one pair of token lists."""
    run = longest_run(a, b)
    one, two = set(a), set(b)
    both = len(one & two)
    sets = 0.95 * both / len(one | two) if both and len(one - two) <= 1 and len(two - one) <= 1 else 0.0
    x, y = "".join(a), "".join(b)
    d, longer = edits(x, y), max(len(x), len(y))
    return max(run / (len(a) + len(b) - run), sets, 0.9 * (1 - d / longer) if d <= 1 and 1 - d / longer >= 0.75 else 0.0)


@pytest.mark.parametrize("letters", ["abcde", "ab"])
def test_best_match_equals_comparing_all_pairs(spark, letters):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 3, 5])))
    name = lambda: [word() for _ in range(rng.randrange(1, 5))]
    # One token in most names: a key that nearly every column shares.
    sides = {s: {f"{s}{i}": (["id"] if rng.random() < 0.5 else []) + name() for i in range(80)} for s in ("s", "t")}
    types = ["int", "string", "date"]
    typed = {k: rng.choice(types) for side in sides.values() for k in side}
    rows = [("source" if s == "s" else "target", table, "_".join(tokens), typed[table]) for s, side in sides.items() for table, tokens in side.items()]
    c = catalog(spark, *rows)
    best = matching.best_matches(matching.named_columns(c))
    got = {r["qualified"]: (r["source"]["qualified"], round(r["score"], 9)) for r in best.collect()}
    expected = {}
    for t, tt in sides["t"].items():
        scored = []
        for s, st in sides["s"].items():
            if likeness := name_score(st, tt):
                scored.append((-round(0.8 * likeness + (0.2 if typed[s] == typed[t] else 0.0), 9), f"{s}.{'_'.join(st)}"))
        if scored:
            score, source = min(scored)
            expected[f"{t}.{'_'.join(tt)}"] = (source, -score)
    assert got == expected
    items = matching.match_columns(c)
    assert matching.unknown_references(items, c).count() == 0
    assert items.count() == 80


def broadcasts(df):
    """Rows that the finished plan of a collected table sent to every task."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_keys_of_names_are_not_broadcast(spark):
    """Keys come out of a generator, and the tables from small files: their size is not what Spark takes it for."""
    names = ["_".join([*"abcdefgh"[i % 8 :], f"w{i}"]) for i in range(60)]
    rows = [(r, side, "t", n, "int") for r in "01" for side in ("source", "target") for n in names]
    catalog = spark.createDataFrame(rows, "request_id string, side string, table_name string, column_name string, data_type string")
    items = matching.match_columns(catalog)
    for df in (matching.best_matches(matching.named_columns(catalog)), items, matching.unknown_references(items, catalog), matching.coverage(items, catalog)):
        df.collect()
        assert broadcasts(df) == 0


def test_spelling_and_order_decide(spark):
    names = lambda side, *names: [(side, side[0], n, "varchar") for n in names]
    c = catalog(spark, *names("source", "customers", "id_customer_order", "ship_date"), *names("target", "customer", "custmers", "customer_id_order", "shipdate", "x", ""))
    got = {r["target_column"]: (r["source_columns"], round(r["confidence_score"], 3)) for r in matching.match_columns(c).collect()}
    assert got["t.customer"] == (["s.customers"], 0.84) and got["t.custmers"] == (["s.customers"], 0.84)
    assert got["t.customer_id_order"] == (["s.id_customer_order"], 0.96) and got["t.shipdate"] == (["s.ship_date"], 0.92)
    assert got["t.x"] == ([], 0.0) and len(got) == 6


def test_a_type_given_twice_and_an_empty_catalogue(spark):
    c = catalog(spark, ("source", "s", "a", "int"), ("source", "s", "a", "date"), ("target", "t", "a", None), ("target", "t", "b", "int"))
    got = {r["target_column"]: (r["source_columns"], r["match_type"]) for r in matching.match_columns(c).collect()}
    assert got == {"t.a": (["s.a"], "semantic"), "t.b": ([], "incompatible")}
    assert matching.match_columns(c.limit(0)).count() == 0


# --- chunks -------------------------------------------------------------------------------------------------------

CHUNK = "request_id string, seq bigint, event_type string, payload string, ts timestamp"


def events(spark):
    rng = random.Random(2)
    rows = []
    for r in range(30):
        for seq in range(rng.randrange(1, 15)):
            kind = rng.choice(["token"] * 6 + ["progress", "result", "error"])
            rows.append((f"r{r}", seq, kind, rng.choice(["", "a", "é", f"x{seq}"]), T0 + dt.timedelta(seconds=r * 60 + seq)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, CHUNK), rows


def test_stream_equals_batch(spark, tmp_path):
    batch, rows = events(spark)
    closing = spark.createDataFrame([("closing", 0, "token", "x", T0 + dt.timedelta(days=9))], CHUNK)
    batch.unionByName(closing).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in"))
    chunks.write_folds(chunks.fold_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    streamed = {r["request_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    tokens = batch.filter("event_type = 'token'")
    folded = {r["request_id"]: r for r in chunks.fold_chunks(tokens).collect()}
    outcomes = {r["request_id"]: r["outcome"] for r in chunks.request_outcomes(batch).collect()}
    progress = {r["request_id"]: r["detail"] for r in chunks.latest_progress(batch).collect()}
    assert set(streamed) == {r[0] for r in rows}
    for key, s in streamed.items():
        b = folded.get(key)
        assert (s["n_chunks"], s["n_chars"], s["reply_text"]) == ((b["n_chunks"], b["n_chars"], b["reply_text"]) if b else (0, 0, ""))
        assert s["outcome"] == outcomes[key] and s["detail"] == progress.get(key)


def streamed(spark, tmp_path, tables, fold):
    """Rows of a fold over tables that arrive one after the other."""
    for rows in tables:
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunks.write_folds(fold(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    return {r["request_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}, query


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_chunks_out_of_order_are_put_in_place_and_lost_ones_show(spark, tmp_path):
    token = lambda r, seq, minute: (r, seq, "token", f"{r}{seq} ", at(minute))
    first = [token("a", 4, 1), token("a", 1, 3), token("b", 2, 1), ("c", 1, "token", "", at(1)), token("d", 1, 1), token("d", 1, 1)]
    second = [token("a", 3, 0), token("a", 2, 4), token("b", 1, 1), ("c", 2, "result", "{}", at(2)), token("e", 1, 1), token("e", 3, 1)]
    markers = [[("m", 0, "token", "x", at(10_000))], [("m", 1, "token", "x", at(10_001))]]
    late = [token("e", 2, 1)]
    closing = [("closing", 0, "token", "x", at(90_000))]
    fold = lambda s: chunks.fold_stream(s, gap="20 minutes", delay="30 minutes")
    rows, _ = streamed(spark, tmp_path, [first, second, *markers, late, closing], fold)
    got = {k: (r["n_chunks"], r["reply_text"], r["complete"]) for k, r in rows.items() if k in "abcde"}
    assert got == {"a": (4, "a1 a2 a3 a4 ", True), "b": (2, "b1 b2 ", True), "c": (0, "", True), "d": (2, "d1 d1 ", False), "e": (2, "e1 e3 ", False)}
    assert rows["c"]["outcome"] == "result"


def test_outcomes_leave_at_once_and_tokens_are_not_kept(spark, tmp_path):
    first = [("a", 1, "token", "t", at(0)), ("a", 2, "result", "{1}", at(1)), ("b", 1, "progress", "p", at(1))]
    again = [("a", 2, "result", "{1}", at(1)), ("a", 3, "error", "late", at(2)), ("b", 2, "error", "e", at(2))]
    rows, query = streamed(spark, tmp_path, [first, again], chunks.early_outcomes)
    assert {k: (r["outcome"], r["payload"]) for k, r in rows.items()} == {"a": ("result", "{1}"), "b": ("error", "e")}
    state = query.lastProgress["stateOperators"]
    assert len(state) == 1 and state[0]["numRowsTotal"] <= 2
    plan = chunks.outcome_stream(spark.createDataFrame(first, CHUNK))
    assert "CASE WHEN NOT (event_type" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_many_files_arrive_in_few_batches(spark, monkeypatch):
    """A table that arrives is one batch, so the batches do not grow in number with the files."""
    from workloads import streams

    schema = "request_id string, seq bigint, event_type string, payload string, ts string"
    rows = [(str(i), 1, "result", f"end {i}", "2024-01-01 10:00:00") for i in range(60)]
    ends, folders, plain = spark.createDataFrame(rows, schema).repartition(12, "request_id"), [], chunks.write_folds
    monkeypatch.setattr(streams.chunks, "write_folds", lambda folded, path, checkpoint, **more: folders.append(checkpoint) or plain(folded, path, checkpoint, **more))
    out = streams._streamed(spark, [ends, ends], chunks.early_outcomes)
    assert sorted(r["request_id"] for r in out.collect()) == sorted(str(i) for i in range(60))
    commits = [f for f in os.listdir(f"{folders[0]}/commits") if f.isdigit()]
    assert len(set(folders)) == 1 and len(commits) <= 6


def test_outcome_stream_equals_batch(spark, tmp_path):
    batch, rows = events(spark)
    closing = [("closing", 0, "token", "x", T0 + dt.timedelta(days=9))]
    got, _ = streamed(spark, tmp_path, [rows, closing], chunks.outcome_stream)
    assert {k: (r["outcome"], r["payload"]) for k, r in got.items()} == {r["request_id"]: (r["outcome"], r["payload"]) for r in chunks.request_outcomes(batch).collect()}
    progress = {r["request_id"]: r["detail"] for r in chunks.latest_progress(batch).collect()}
    assert all(r["detail"] == progress.get(k) for k, r in got.items())


def test_complete_replies_in_batch(spark):
    rows = [("a", i, "token", "x", T0) for i in (3, 4, 5)] + [("b", i, "token", "x", T0) for i in (1, 3)] + [("c", 1, "token", "x", T0)] * 2
    got = {r["request_id"]: r["complete"] for r in chunks.complete_replies(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_long_replies_stay_in_parts(spark):
    rows = [("a", i, "token", "xy", T0) for i in range(10)] + [("b", 0, "token", "z", T0)]
    df = spark.createDataFrame(rows, CHUNK)
    folded = {r["request_id"]: (r["n_chunks"], r["n_chars"], r["reply_text"]) for r in chunks.fold_chunks(df).collect()}
    assert folded == {"a": (10, 20, "xy" * 10), "b": (1, 1, "z")}
    parts = chunks.fold_parts(df, chunks_per_part=4).filter("request_id = 'a'").orderBy("part").collect()
    assert [p["text"] for p in parts] == ["xy" * 4, "xy" * 4, "xy" * 2]


def test_event_text(spark):
    text = 'event: progress\ndata: {"phase":"p","detail":"d"}\n\nevent: x\n event: token\ndata: {"token":"t"}\ndata: {"a":1}\nevent: error\ndata: oops\ndata: {"b":2}\nevent: odd\ndata: 1'
    df = spark.createDataFrame([("0", text)], "request_id string, event_text string")
    decoded = chunks.decode_event_text(df)
    assert [(r["seq"], r["event_type"], r["known"]) for r in decoded.orderBy("seq").collect()] == [(0, "progress", True), (1, "token", True), (2, "", False), (4, "", False), (5, "odd", False)]
    assert [(r["event_type"], r["payload"]) for r in chunks.event_payloads(decoded).orderBy("seq").collect()] == [("progress", "d"), ("token", "t")]
