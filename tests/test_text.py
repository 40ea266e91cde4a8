from pyspark.sql import functions as F

from colweave.functions import delimited as d
from colweave.functions import text as t
from colweave.functions.confidence import column_part, confidence_percent, source_table, table_part
from colweave.functions.json_text import kind, strict_json


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def test_trim_strips_unicode_space(spark):
    assert one(spark, t.trim_ws(F.col("v")), " \t a b  \n") == "a b"
    assert one(spark, t.is_blank(F.col("v")), "　 \r\n") is True
    assert one(spark, t.is_blank(F.col("v")), None) is True


def test_length_counts_utf16_units(spark):
    assert one(spark, t.utf16_length(F.col("v")), "😀a") == 3
    assert one(spark, t.utf16_length(F.col("v")), "éa") == 2
    assert one(spark, t.estimate_tokens(F.col("v")), "12345") == 2
    assert one(spark, t.estimate_tokens(F.col("v")), "") == 0


def test_file_names(spark):
    assert one(spark, t.file_extension(F.col("v")), "a.b.CSV") == "csv"
    assert one(spark, t.base_name(F.col("v")), "a.b.CSV") == "a.b"
    assert one(spark, t.file_extension(F.col("v")), "plain") == ""


def test_last_position(spark):
    assert one(spark, t.last_position(F.col("v"), "}"), "a}b}c") == 4
    assert one(spark, t.last_position(F.col("v"), "}"), "abc") == 0


def test_user_label(spark):
    assert one(spark, t.short_user_label(F.col("v"), F.lit(" Ann ")), "0123456789abcdef") == "Ann"
    assert one(spark, t.short_user_label(F.col("v"), F.lit(None)), "0123456789abcdef") == "User 01234567…"
    assert one(spark, t.short_user_label(F.col("v"), F.lit(" ")), "0123456789ab") == "0123456789ab"


def test_delimiter_vote_prefers_comma_then_tab_then_semicolon(spark):
    vote = d.vote_delimiter(F.col("v"))
    assert one(spark, vote, "a") == ","
    assert one(spark, vote, "a,b;c") == ","
    assert one(spark, vote, "a;b|c\td") == "\t"
    assert one(spark, vote, "a;b|c") == ";"
    assert one(spark, vote, "a|b|c,d") == "|"


def test_presence_delimiter_ignores_pipe(spark):
    assert one(spark, d.presence_delimiter(F.col("v")), "a|b") == ","
    assert one(spark, d.presence_delimiter(F.col("v")), "a;b,c,d") == ";"
    assert one(spark, d.presence_delimiter(F.col("v")), "a;b\tc") == "\t"


def test_quotes_toggle_and_vanish(spark):
    cells = d.split_quoted(F.col("v"), F.lit(","))
    assert one(spark, cells, '"a,b", c ,""') == ["a,b", "c", ""]
    assert one(spark, cells, 'a"b,c') == ["ab,c"]
    assert one(spark, cells, 'x""y,z') == ["xy", "z"]
    assert one(spark, cells, "") == [""]


def test_dictionary_needs_two_keywords(spark):
    assert one(spark, d.looks_like_dictionary(F.col("v")), "Table_Name;x") is False
    assert one(spark, d.looks_like_dictionary(F.col("v")), "TABLE;Comment") is True


def test_strict_json_rejects_what_follows_the_value(spark):
    doc = strict_json(F.col("v"))
    for bad in ("{} x", "{}}", "{}] [{}", "{},{}", '{"a":1,}', "", "{", "{} {}", "1 2"):
        assert one(spark, doc.isNull(), bad) is True, bad
    for good in ("{}", " [1] ", "null", '"x"', "1.5", '{"a":{"b":[]}}'):
        assert one(spark, doc.isNull(), good) is False, good


def test_kinds(spark):
    for text, expected in (("{}", "object"), ("[1]", "array"), ('"x"', "string"), ("true", "boolean"), ("null", "null"), ("1", "number"), ("1.5", "number"), ("1e3", "number")):
        assert one(spark, kind(strict_json(F.col("v"))), text) == expected


def test_confidence_percent(spark):
    # 0.285 * 100 is a little below 28.5 in binary.
    for score, percent in ((0.0, 0), (0.285, 28), (1.0, 100), (1.5, 2), (80.0, 80)):
        got = spark.createDataFrame([(score,)], "s double").select(confidence_percent(F.col("s"))).first()[0]
        assert got == percent, score


def test_qualified_names(spark):
    assert one(spark, table_part(F.col("v")), "a.b.c") == "a.b"
    assert one(spark, table_part(F.col("v")), "c") == "Mappings"
    assert one(spark, column_part(F.col("v")), "a.b.c") == "c"
    assert one(spark, source_table(F.col("v")), "a.b.c") == "a"
    assert one(spark, source_table(F.col("v")), ".b") is None
    assert one(spark, source_table(F.col("v")), "b") is None


def test_script_trimming_knows_the_byte_order_mark(spark):
    from colweave.sources.files import file_statistics

    files = spark.createDataFrame([("0", "source", 0, "a.csv", "\ufeffid,name\n1,x\n")], "request_id string, side string, pos bigint, file_name string, content string")
    assert files.select(d.first_line(F.col("content"))).first()[0] == "id,name"
    assert file_statistics(files).first()["n_rows"] == 1


def test_kinds_must_fit_all_the_way_down(spark):
    from colweave.functions.json_text import fits, strict_json
    from colweave.schemas import MAPPING_RESULT, SESSION_FILES

    texts = ['[{"fileName":"a","content":null}]', "[]", "[{}]", '[{"fileName":5}]', '["a"]', '{"global_confidence":"x"}', '{"global_confidence":0.5,"mappings":[{"source_columns":["a"]}]}', '{"mappings":[{"source_columns":[1]}]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", strict_json(F.col("t")))
    assert [r[0] for r in df.select(fits(F.col("v"), SESSION_FILES)).collect()][:5] == [True, True, True, False, False]
    assert [r[0] for r in df.select(fits(F.col("v"), MAPPING_RESULT)).collect()][5:] == [False, True, False]
