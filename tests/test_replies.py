import json

import pytest

from colweave.operators import replies

PLAIN = {"target_column": "t.a", "source_columns": ["s.a"], "confidence_score": 0.9, "match_type": "exact", "reasoning": "r", "transformation_rule": None}


def normalize(spark, text, **options):
    df = spark.createDataFrame([("0", text)], "request_id string, reply_text string")
    return replies.normalize_replies(df, **options).first()


def items(spark, *rows, **options):
    result = normalize(spark, json.dumps({"mappings": list(rows)}), **options)
    assert result["error"] is None
    return [m.asDict() for m in result["mappings"]]


def test_fenced_block_is_taken_as_it_is(spark):
    body = json.dumps({"mappings": [PLAIN]})
    assert normalize(spark, f"{{x}} ```json\n{body}\n``` after }}")["mappings"][0].asDict() == PLAIN
    assert normalize(spark, f"```\n{body}```")["error"] is None
    assert normalize(spark, '```json\n{"mappings":[],}\n```')["error"] == "invalid JSON"


def test_braces_are_repaired(spark):
    r = normalize(spark, 'text {"mappings":[{"target":"a", "source_columns":["x", ],\n } ],} tail')
    assert r["error"] is None and r["mappings"][0]["source_columns"] == ["x"]
    for bad in ('{"mappings":[1,]}', '{"unmapped_source_columns":["a",\n]}'):
        assert normalize(spark, bad)["error"] == "invalid JSON"


def test_errors(spark):
    assert normalize(spark, " \n")["error"] == "empty reply"
    assert normalize(spark, None)["error"] == "empty reply"
    assert normalize(spark, "} nothing {")["error"] == "no JSON in reply"
    assert normalize(spark, "```\n[1]\n```")["error"] == "mapping is not an object"


def test_mapping_key_only_without_mappings(spark):
    assert len(normalize(spark, json.dumps({"mapping": [PLAIN]}))["mappings"]) == 1
    assert len(normalize(spark, json.dumps({"mapping": [PLAIN], "mappings": []}))["mappings"]) == 0
    assert normalize(spark, json.dumps({"mapping": [PLAIN], "mappings": None}))["error"] == "unexpected kind of value"
    assert normalize(spark, "{}")["mappings"] == []


def test_envelope(spark):
    body = {"mappings": [PLAIN]}
    wrapped = normalize(spark, json.dumps({"mapping": body, "message": "ok"}), envelope=True)
    assert (len(wrapped["mappings"]), wrapped["message"]) == (1, "ok")
    assert normalize(spark, json.dumps(body), envelope=True)["message"] == "Mapping updated."
    assert normalize(spark, json.dumps({"mapping": body, "message": None}), envelope=True)["message"] == "Mapping updated."
    assert normalize(spark, json.dumps({"mapping": [PLAIN]}), envelope=True)["error"] == "mapping is not an object"


def test_target_name(spark):
    assert items(spark, {"target_column": None, "target": "x"}) == []
    assert items(spark, {"target_column": ""}) == []
    assert items(spark, {"target": "x", "target_table": "t"})[0]["target_column"] == "t.x"
    assert items(spark, {"target_column": "u.x", "target_table": "t"})[0]["target_column"] == "u.x"
    assert items(spark, {"target_column": "x", "target_table": ""})[0]["target_column"] == "x"


def test_sources(spark):
    got = items(spark, {"target": "x", "source_table": "s", "source_columns": ["a", "", None, "q.b"]})
    assert got[0]["source_columns"] == ["s.a", "q.b"]
    single = {"target": "x", "source_table": "s", "source_column": "a"}
    assert items(spark, single)[0]["source_columns"] == []
    assert items(spark, single, aliases=True)[0]["source_columns"] == ["s.a"]
    assert items(spark, {"target": "x", "source": None}, aliases=True)[0]["source_columns"] == [""]


def test_field_aliases(spark):
    got = items(spark, {"target": "x", "confidence": 1, "reason": "why", "transformation": "f(a)"})[0]
    assert (got["confidence_score"], got["reasoning"], got["transformation_rule"]) == (1.0, "why", "f(a)")
    got = items(spark, {"target": "x", "reasoning": None, "reason": "why", "transformation_rule": None, "transformation": "f"})[0]
    assert (got["confidence_score"], got["reasoning"], got["transformation_rule"]) == (0.0, "", None)


@pytest.mark.parametrize("given", ["manual", "Exact", "", None])
def test_other_match_types_become_semantic(spark, given):
    assert items(spark, {"target": "x", "match_type": given})[0]["match_type"] == "semantic"
    assert items(spark, {"target": "x"})[0]["match_type"] == "semantic"


def test_duplicates_merge(spark):
    first = dict(PLAIN, target_column="t", source_columns=["a", "b"], confidence_score=0.4, reasoning="one", transformation_rule="f")
    other = dict(PLAIN, target_column="u", source_columns=["z", "z"])
    again = dict(PLAIN, target_column="t", source_columns=["b", "c"], confidence_score=0.3, match_type="derived", reasoning="", transformation_rule=None)
    got = items(spark, first, other, again)
    assert [g["target_column"] for g in got] == ["t", "u"]
    assert got[0] == dict(target_column="t", source_columns=["a", "b", "c"], confidence_score=0.4, match_type="derived", reasoning="", transformation_rule="f")
    assert got[1]["source_columns"] == ["z", "z"]


def test_result_fields(spark):
    two = [dict(PLAIN, target_column="a"), dict(PLAIN, target_column="b", confidence_score=0.5)]
    r = normalize(spark, json.dumps({"mappings": two}))
    assert r["global_confidence"] == pytest.approx(0.7)
    assert (r["unmapped_source_columns"], r["unmapped_target_columns"], r["analysis_summary"]) == ([], [], "")
    r = normalize(spark, json.dumps({"mappings": two, "global_confidence": 3, "analysis_summary": None, "unmapped_source_columns": ["", "x"]}))
    assert (r["global_confidence"], r["analysis_summary"], r["unmapped_source_columns"]) == (3.0, "", ["x"])
    assert normalize(spark, "{}")["global_confidence"] == 0.0


@pytest.mark.parametrize(
    "bad",
    [
        {"mappings": [dict(PLAIN, source_columns=["x", 1])]},
        {"mappings": [dict(PLAIN, source_columns=None)]},
        {"mappings": [dict(PLAIN, confidence_score="high")]},
        {"mappings": [dict(PLAIN, confidence_score=None)]},
        {"mappings": [dict(PLAIN, match_type=1)]},
        {"mappings": [dict(PLAIN, target_column=7)]},
        {"mappings": [dict(PLAIN, target_table=[])]},
        {"mappings": ["text"]},
        {"mappings": {}},
        {"global_confidence": None},
        {"analysis_summary": 5},
        {"unmapped_target_columns": "x"},
    ],
)
def test_wrong_kinds_fail_the_reply(spark, bad):
    r = normalize(spark, json.dumps(bad))
    assert r["error"] == "unexpected kind of value" and r["mappings"] is None


def test_fields_of_dropped_items_do_not_matter(spark):
    assert items(spark, {"target_column": "", "source_columns": [1], "confidence_score": "x"}) == []


def test_repeated_keys_keep_the_last(spark):
    assert normalize(spark, '{"mappings":[{"target":"a","target":"b"}]}')["mappings"][0]["target_column"] == "b"


def test_tables(spark):
    df = spark.createDataFrame([("0", json.dumps({"mappings": [PLAIN]})), ("1", "")], "request_id string, reply_text string")
    normalized = replies.normalize_replies(df)
    assert [(r["request_id"], r["target_column"], r["pos"]) for r in replies.reply_items(normalized).collect()] == [("0", "t.a", 0)]
    assert [(r["request_id"], r["error"]) for r in replies.reply_errors(normalized).collect()] == [("1", "empty reply")]
