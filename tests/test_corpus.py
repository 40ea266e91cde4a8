import json
import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import budget, catalog, reduction
from colweave.sources import files as sources


def reduced(files, level, name, content):
    return reduction.reduce_files(files((name, content)), level).first()["content"]


@pytest.mark.parametrize("level,limit", [("light", 21), ("medium", 6), ("heavy", 3)])
def test_delimited_limits(files, level, limit):
    lines = [f"r{i}" for i in range(limit)]
    # Blank lines do not count, and a file within the limit keeps them.
    text = "\n\n".join(lines) + "\n \n"
    assert reduced(files, level, "a.csv", text) == text
    longer = "\n".join([*lines, "", "more"])
    assert reduced(files, level, "a.txt", longer) == "\n".join(lines) + f"\n... (1 more data rows, {limit + 1} total)"


def test_light_keeps_dictionaries(files):
    text = "table,column\n" + "\n".join(f"t,c{i}" for i in range(30))
    assert reduced(files, "light", "a.csv", text) == text


def test_heavy_keeps_essential_columns(files):
    text = "table ;x; Column Name;type\nt;1;a\n\nt;2;b;int;extra"
    assert reduced(files, "medium", "a.csv", text) == text
    assert reduced(files, "heavy", "a.csv", text + "\nt;3;c;date") == (
        "table;Column Name;type\nt;a;\nt;b;int\nt;c;date\n(compressed: kept 3 of 4 columns)"
    )


def test_heavy_falls_back_to_cutting_cells(files):
    # Two dictionary words in one header cell: only one essential column.
    long = "y" * 51
    text = "\n".join(["nullable comment,my type", *[f"{long},b"] * 3])
    assert reduced(files, "heavy", "a.csv", text) == "\n".join(["nullable comment,my type", *[f"{'y' * 50}...,b"] * 3])


def test_json_arrays(files):
    text = '[{"b": 1, "a": [1, 2]}, "x\\"y", null, 4]'
    assert reduced(files, "light", "a.json", text) == text
    assert reduced(files, "medium", "a.json", text) == '[\n{"b": 1, "a": [1, 2]},\n"x\\"y"\n]\n// ... (2 more objects, 4 total)'
    assert reduced(files, "heavy", "a.json", "[1] tail") == "[1] tail"


def test_other_text_is_cut_by_lines(files):
    text = "\n".join(str(i) for i in range(51)) + "\n"
    assert reduced(files, "heavy", "a.md", text) == "\n".join(str(i) for i in range(50)) + "\n... (truncated from 52 lines)"
    assert reduced(files, "heavy", "a.json", text).endswith("(truncated from 52 lines)")
    assert reduced(files, "medium", "a.md", text) == text
    pretty = json.dumps([{"a": list(range(60))}], indent=1)
    assert reduced(files, "heavy", "b.json", pretty).endswith("lines)")


def test_tier_fits_or_is_heavy(spark, files):
    rows = []
    for r, lines in enumerate((2, 40, 200, 2000, 20000)):
        rows += [(str(r), side, f"{side}.csv", "\n".join("x" * 30 for _ in range(lines))) for side in ("source", "target")]
        rows.append((str(r), "source", "n.md", "\n".join("y" * 40 for _ in range(lines))))
    requests = spark.createDataFrame([(str(r), None, None) for r in range(5)], "request_id string, user_instruction string, rules string")
    raw = files(*rows)
    plan = {p["request_id"]: p for p in budget.plan_requests(raw, requests, token_limit=8000).collect()}
    assert all(p["tier_tokens"] <= 8000 or p["tier"] == "heavy" for p in plan.values())
    assert {p["tier"] for p in plan.values()} >= {"raw", "light", "medium"}
    # The estimate of the chosen tier is that of the reduced files.
    for p in plan.values():
        chosen = raw.filter(F.col("request_id") == p["request_id"])
        if p["tier"] != "raw":
            chosen = reduction.reduce_files(chosen, p["tier"])
        total = sum(-(-len(f["content"]) // 4) + -(-len(f["file_name"]) // 4) + 20 for f in chosen.collect())
        assert p["tier_tokens"] == total + 609 + 4200


def test_prompt_text(spark, files):
    raw = files(("1", "target", "t.md", "T"), ("1", "source", "s.md", "S1"), ("1", "source", "u.md", "S2"), ("2", "source", "s.md", "S"))
    requests = spark.createDataFrame([("1", " do it ", "r1\n"), ("2", None, None), ("3", None, " ")], "request_id string, user_instruction string, rules string")
    plan = budget.plan_requests(raw, requests)
    prompts = {p["request_id"]: p["prompt"] for p in budget.build_prompts(raw, plan).collect()}
    assert set(prompts) == {"1"}
    assert prompts["1"] == (
        budget.PROMPT_HEAD + "\n\nUser's instruction: do it\n\nADDITIONAL RULES (you MUST follow these):\nr1"
        "\n\n=== SOURCE FILES ===\n\n--- File: s.md ---\nS1\n\n--- File: u.md ---\nS2\n\n=== TARGET FILES ===\n\n--- File: t.md ---\nT\n"
    )
    refused = {p["request_id"] for p in plan.filter("reject_reason is not null").collect()}
    assert refused == {"2", "3"}


def columns(df):
    return [(r["table_name"], r["column_name"], r["ordinal"], r["data_type"], r["nullable"]) for r in df.orderBy("table_name", "ordinal").collect()]


def test_columns_by_form(files):
    doc = '{"table_name":"old","columns":[{"name":"dob","data_type":"date","nullable":true},{"x":1},{"name":"id"}]}'
    assert columns(catalog.list_columns(files(("a.json", doc)))) == [("old", "dob", 1, "date", True), ("old", "id", 2, None, None)]
    unnamed = '{"table_name":"","columns":[{"name":"dob"}]}'
    assert columns(catalog.list_columns(files(("x.y.json", unnamed))))[0][:2] == ("x.y", "dob")
    array = '[{"z":1,"a":{"b":2}},{"q":1}]'
    assert [c[:3] for c in columns(catalog.list_columns(files(("rows.json", array))))] == [("rows", "z", 1), ("rows", "a", 2)]
    for nothing in ("[]", "3", "null", '{"columns":null}', '{"columns":0}', '{"a":1}', "[1,2]"):
        assert columns(catalog.list_columns(files(("n.json", nothing)))) == [], nothing
    # A `columns` of another kind, and anything that is not JSON, is listed by its first line.
    assert [c[1] for c in columns(catalog.list_columns(files(("o.json", '{"columns":"a;b"}'))))] == ['{"columns":"a', 'b"}']
    assert [c[1] for c in columns(catalog.list_columns(files(("h.csv", "\n a ,b;;c|\td \r\n1,2"))))] == ["a", "b", "c", "d"]


def test_described_columns(files):
    dictionary = "table,column,type,nullable\nnew,id,string,false\n\n,name,,yes\nnew, ,int,true"
    text = "=== ORDERS TABLE (old_orders) ===\norder_id (bigint, PK)\ntotal (decimal(10,2))\nnote\n=== MORE (m) ===\nstatus (varchar: A, B)"
    got = columns(catalog.described_columns(files(("d.csv", dictionary), ("t.txt", text), ("p.csv", "a,b\n1,2"))))
    assert got == [
        ("d", "name", 2, None, True),
        ("m", "status", 3, "varchar", None),
        ("new", "id", 1, "string", False),
        ("old_orders", "order_id", 1, "bigint", None),
        ("old_orders", "total", 2, "decimal(10,2)", None),
        ("p", "a", 1, None, None),
        ("p", "b", 2, None, None),
    ]
    found = catalog.search_columns(catalog.list_columns(files(("p.csv", "Alpha,beta"))), " P.AL ")
    assert [r["qualified"] for r in found.collect()] == ["p.Alpha"]


def test_preview_and_statistics(files):
    raw = files(("a.csv", "h1;h2\n" + "\n\n".join(f'{i};"x;{i}"' for i in range(60)) + "\n"), ("b.txt", " \n"))
    stats = {s["file_name"]: (s["n_columns"], s["n_rows"]) for s in sources.file_statistics(raw).collect()}
    assert stats == {"a.csv": (2, 60), "b.txt": (0, 0)}
    shown = sources.preview_rows(raw).orderBy("row_no").collect()
    assert len(shown) == 50 and shown[0]["cells"] == ["0", "x;0"] and {r["n_more"] for r in shown} == {10}


def test_json_profile(files):
    rows = sources.profile_json(files(("a.json", '{"a":[1,{"b":null}],"c":"x"}'), ("bad.json", "{"))).collect()
    got = {(r["path"], r["depth"], r["kind"], r["n_children"]) for r in rows}
    assert got == {
        ("$", 0, "object", 2), ("$.a", 1, "array", 2), ("$.a[0]", 2, "number", 0), ("$.a[1]", 2, "object", 1), ("$.a[1].b", 3, "null", 0), ("$.c", 1, "string", 0),
    }
    deep = "[" * 30 + "]" * 30
    assert max(r["depth"] for r in sources.profile_json(files(("d.json", deep))).collect()) == 20


def test_scans_of_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n\n3,4\n")
    (tmp_path / "b.txt").write_text("only line")
    raw = sources.scan_raw_files(spark, str(tmp_path), "source")
    assert {(r["file_name"], r["content"]) for r in raw.collect()} == {("a.csv", "x,y\n1,2\n\n3,4\n"), ("b.txt", "only line")}
    heads = sources.head_lines(sources.scan_file_lines(spark, str(tmp_path), "source"), 2)
    assert [(r["file_name"], r["line_no"], r["line"]) for r in heads.orderBy("file_name", "line_no").collect()] == [
        ("a.csv", 1, "x,y"), ("a.csv", 2, "1,2"), ("b.txt", 1, "only line"),
    ]
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()


# --- raw elements and lengths --------------------------------------------------------------------------------------


def written(rng, depth=0):
    """A JSON value as text, with odd spacing and spelling."""
    space = lambda: rng.choice(["", " ", "\n", "\t "])
    kind = rng.choice(["n", "s", "c"] + ["a", "o"] * (depth < 3))
    if kind == "n":
        return rng.choice(["1.50", "1e3", "-0", "0.10", "12", "1E-7"])
    if kind == "s":
        return json.dumps(rng.choice(["", "a,b", "]}[{", 'q"\\', "é\U0001f600", "x" * 60]), ensure_ascii=rng.random() < 0.5)
    if kind == "c":
        return rng.choice(["true", "false", "null"])
    items = [written(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == "o":
        items = [f'{space()}"k{i}"{space()}:{space()}{v}' for i, v in enumerate(items)]
        return "{" + f"{space()},{space()}".join(items) + space() + "}"
    return "[" + space() + f"{space()},{space()}".join(items) + space() + "]"


def test_kept_json_elements_are_cut_from_the_raw_text(files):
    rng = random.Random(4)
    arrays = [[written(rng) for _ in range(n)] for n in (0, 1, 2, 3, 5, 6, 7, 9) for _ in range(6)]
    texts = [" \n[ " + " ,\n".join(a) + "\t]\n" for a in arrays]
    frame = files(*[(f"f{i}.json", t) for i, t in enumerate(texts)])
    for level, keep in (("light", 5), ("medium", 2), ("heavy", 1)):
        got = {r["file_name"]: r["content"] for r in reduction.reduce_files(frame, level).collect()}
        for i, (a, t) in enumerate(zip(arrays, texts)):
            json.loads(t)
            cut = "[\n" + ",\n".join(a[:keep]) + f"\n]\n// ... ({len(a) - keep} more objects, {len(a)} total)"
            assert got[f"f{i}.json"] == (cut if len(a) > keep else t)


def test_lengths_are_those_of_the_reduced_texts(spark, files):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "é", "\U0001f600" * 3, "x" * 70, "é" * 49 + "\U0001f600", "", " pad "])
    rows = [("empty.csv", ""), ("blank.txt", " \n \n"), ("e.json", "[]"), ("bad.json", "[1,\n" * 600), ("noext", "a\nb"), ("long.md", "l\n" * 700)]
    for i in range(40):
        d = rng.choice([",", ";", "\t"])
        head = rng.choice([["Table Name", "Column", "Data Type", "note"], ["table", "x"], ["id", "v"], ["TABLE", "field", "descr"]])
        lines = [d.join(head)] + [d.join(word() for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([1, 4, 9, 30]))]
        rows.append((f"d{i}.{rng.choice(['csv', 'tsv', 'txt'])}", rng.choice(["\n", "\n\n"]).join(lines)))
        rows.append((f"j{i}.json", "[" + ",".join(written(rng) for _ in range(rng.randrange(9))) + "]"))
    frame = files(*rows)
    utf16 = lambda t: len(t.encode("utf-16-le")) // 2
    lengths = {r["file_name"]: r for r in reduction.file_lengths(frame).collect()}
    assert all(lengths[n]["len_raw"] == utf16(t) for n, t in rows)
    for level in ("light", "medium", "heavy"):
        for r in reduction.reduce_files(frame, level).collect():
            assert lengths[r["file_name"]][f"len_{level}"] == utf16(r["content"]), (level, r["file_name"])
    plan = reduction.file_lengths(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "more data rows" not in plan and "array_join" not in plan


def test_many_searches_at_once_equal_one_by_one(spark):
    names = ["Orders.id", "orders.Order Id", "a.b", "x.ab", "x.é%_", "x.aaa"]
    columns = spark.createDataFrame([("0", "source", f, *n.split(".")) for n in names for f in ("one", "two")], "request_id string, side string, file_name string, table_name string, column_name string")
    queries = ["", "  ", None, "o", "ID", "r i", "orders.", "aaa", "aaaa", "%_", "É%", "zzz", ".", "order id", "ab", "aab"]
    searches = spark.createDataFrame(list(enumerate(queries)), "search_id int, query string")
    got = sorted((r["search_id"], r["file_name"], r["qualified"]) for r in catalog.search_columns_for(columns, searches).collect())
    want = sorted((i, r["file_name"], r["qualified"]) for i, q in enumerate(queries) for r in catalog.search_columns(columns, q or "").collect())
    assert got == want
    assert catalog.search_columns_for(columns.limit(0), searches).count() == 0 and catalog.search_columns_for(columns, searches.limit(0)).count() == 0


def test_equal_searches_are_looked_up_once(spark, tmp_path, monkeypatch):
    """What many users search is found once, not once for each of them."""
    from workloads import corpus

    rows = [(60 * i + k, "red bolt" if k % 2 else "hot ring", "Brand#1", "SMALL", 3, 1.5) for i in range(4) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    plain, asked = corpus.catalog.search_columns_for, []
    monkeypatch.setattr(corpus.catalog, "search_columns_for", lambda columns, searches: asked.append(searches.count()) or plain(columns, searches))
    found = {r["search_id"]: (r["n_found"], r["first_found"]) for r in corpus.a12_bulk_search(spark, str(tmp_path)).collect()}
    searches = corpus._searches(spark, str(tmp_path)).collect()
    assert asked[0] < len(searches) / 10
    names = [c["table_name"] + "." + c["column_name"] for c in catalog.list_columns(corpus.schema_documents(spark, str(tmp_path))).collect()]
    hits = {r["search_id"]: [n for n in names if r["query"].strip().lower() in n.lower()] for r in searches}
    assert found == {k: (len(h), min(h)) for k, h in hits.items() if h}
