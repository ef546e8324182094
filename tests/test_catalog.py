"""Catalog, upload, user and log details the SQL checks do not reach."""

import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark.functions import naming
from docspark.operators import catalog, logs, uploads, users


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("key, expected", [
    ("users/u/uploads/1/raw/a.docx", "users/u/uploads/1/formatted/a_humanized.docx"),
    ("users/u/uploads/1/converted/d/a.DOCX", "users/u/uploads/1/formatted/d/a_humanized.docx"),
    ("x/a.pdf", "x/formatted/a.pdf_humanized.docx"),
    ("a.docx", "formatted/a_humanized.docx"),
    ("u/raw/raw/a.docx", "u/formatted/raw/a_humanized.docx"),
])
def test_rewritten_key(spark, key, expected):
    assert value(spark, naming.rewritten_key, key) == expected


@pytest.mark.parametrize("raw, clean", [
    ("a\tb\r\nc", "abc"), ("“x” – y…  é", '"x" - y... -'), ("  pad ", "pad"), ("", ""),
])
def test_metadata_value(spark, raw, clean):
    assert value(spark, naming.sanitize_metadata_value, raw) == clean


@pytest.mark.parametrize("raw, clean", [(None, ""), ("", ""), ("/a/b//", "a/b/"), (" x ", "x/"), ("///", "")])
def test_destination(spark, raw, clean):
    assert value(spark, naming.normalize_destination_path, raw) == clean


@pytest.mark.parametrize("mb, parts", [(0, 1), (512, 1), (513, 2), (4096, 8), (4097, 8), (1025, 3)])
def test_part_count(spark, mb, parts):
    df = spark.createDataFrame([(mb * 1024 * 1024,)], "s bigint")
    assert df.select(naming.part_count(F.col("s")).alias("p")).first().p == parts


def test_metadata_header(spark):
    def b64(text):
        return base64.b64encode(text.encode()).decode()

    header = f"a {b64('x')},bad,b {b64('ü y')},a {b64('z')}, {b64('q')}"
    assert value(spark, naming.parse_upload_metadata, header) == {"a": "z", "b": "ü y"}


def test_number_duplicates(spark):
    rows = [("d", n, i) for i, n in enumerate(["a.txt"] * 3 + ["b", "b", ".env", ".env", "x.tar.gz", "x.tar.gz"])]
    got = uploads.number_duplicates(spark.createDataFrame(rows, "dir string, name string, ts int")).orderBy("ts")
    assert [r.final_name for r in got.collect()] == [
        "a.txt", "a(1).txt", "a(2).txt", "b", "b(1)", ".env", ".env(1)", "x.tar.gz", "x.tar(1).gz"]


def test_number_duplicates_around_taken_names(spark):
    schema = "dir string, name string, ts int"
    files = spark.createDataFrame([("d", "a.pdf", 1), ("d", "a.pdf", 2), ("d", "a(1).pdf", 3), ("e", "a.pdf", 4), ("e", "a.pdf", 4)], schema)
    assert sorted(r.final_name for r in uploads.number_duplicates(files).collect()) == ["a(1).pdf", "a(1).pdf", "a(2).pdf", "a.pdf", "a.pdf"]
    stored = spark.createDataFrame([("d", n) for n in ("a.pdf", "a(1).pdf", "a(3).pdf", "a(4).pdf", "a(01).pdf")], "dir string, name string")
    new = spark.createDataFrame([("d", "a.pdf", i) for i in range(4)], schema)
    assert [r.final_name for r in uploads.number_duplicates(new, stored).orderBy("ts").collect()] == ["a(2).pdf", "a(5).pdf", "a(6).pdf", "a(7).pdf"]


def test_derived_copy_whose_name_contains_the_source(spark):
    keys = ["users/u/uploads/x/raw/report.docx", "users/u/uploads/x/other/report_v2_humanized.docx", "users/u/uploads/y/other/report_humanized.docx"]
    stored = spark.createDataFrame([(k,) for k in keys], "key string")
    got = catalog.find_derived(stored.limit(1), stored).first()
    assert not got["exists"] and got.alternatives[-1] == keys[1]


def test_filename_strategies(spark):
    files = spark.createDataFrame([(5, "a b.txt")], "upload_id bigint, name string")
    assert uploads.final_names(files).first().final_name == "5"
    assert uploads.final_names(files, "original").first().final_name == "a_b.txt"
    assert uploads.final_names(files, "no such").first().final_name == "5"

    @uploads.filename_strategy("shout")
    def shout(frame):
        return frame.withColumn("final_name", F.upper("name"))

    assert uploads.final_names(files, "shout").first().final_name == "A B.TXT"


def test_html_body(spark):
    cases = {
        "": "", "  ": "", "no tags": "no tags", "<html><BODY class='x'> <p>a</p>\n</BODY></html>": "<p>a</p>",
        "<body></body>": "", "<body> open": "open",
    }
    for html, body in cases.items():
        assert value(spark, catalog.extract_html_body, html) == body


def test_json_redaction(spark):
    cases = {
        '{"Password": "a\\"b", "x": [{"TOKEN":1.5e3}, {"jwt": null}]}':
            '{"Password": "[REDACTED]", "x": [{"TOKEN":"[REDACTED]"}, {"jwt": "[REDACTED]"}]}',
        '{"secret": {"k": [1]}, "passwordless": "keep"}': '{"secret":"[REDACTED]","passwordless":"keep"}',
        '{"token":["a",{"b":{"c":1}}],"n":1}': '{"token":"[REDACTED]","n":1}',
        '{"note":"the \\"token\\": 5"}': '{"note":"the \\"token\\": 5"}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "body string").withColumn("raw", F.col("body"))
    for row in logs.redact_json_bodies(df).collect():
        assert row.body == cases[row.raw]


def test_json_redaction_of_long_strings(spark):
    long = "x\\\\n" * 100_000
    df = spark.createDataFrame([(f'{{"a":"{long}","token":"{long}","b":{{"secret":["{long}"]}}}}',)], "body string")
    assert logs.redact_json_bodies(df).first().body == (
        f'{{"a":"{long}","token":"[REDACTED]","b":{{"secret":"[REDACTED]"}}}}')


def test_truncation(spark):
    assert value(spark, lambda c: logs.truncate_body(c, 5), '"abcdef"') == '"abcd...(+3 more)'
    assert value(spark, lambda c: logs.truncate_body(c, 50), "{broken") is None
    assert value(spark, lambda c: logs.truncate_body(c, 50), '{"a":1}') == '{"a":1}'


def test_request_log_fixture(spark):
    rows = [("POST", 200), ("GET", 200), ("POST", 201), ("GET", 200), ("DELETE", 404), ("GET", 200), ("POST", 401)]
    df = spark.createDataFrame(rows, "method string, status_code int")
    assert [(r.status_code, r.n) for r in logs.status_distribution(df).collect()] == [
        (200, 4), (201, 1), (401, 1), (404, 1)]
    assert {r.method: r.n for r in logs.method_distribution(df).collect()} == {"POST": 3, "GET": 3, "DELETE": 1}


def test_recent_boundary(spark):
    now = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(now - dt.timedelta(hours=24),), (now - dt.timedelta(hours=24, seconds=1),)],
                               "created_at timestamp")
    assert logs.recent_activity(df, F.lit(now)).count() == 1


def test_users(spark):
    rows = [("a@b.co", "abc", "secret", None), ("bad", "ab", "x", "admin"), (None, None, None, None)]
    got = users.validate_users(spark.createDataFrame(rows, "email string, username string, password string, role string"))
    checked = got.collect()
    assert checked[0].reasons == [] and checked[0].role == "user"
    assert len(checked[1].reasons) == 3 and checked[1].role == "admin" and len(checked[2].reasons) == 3


def test_parts_one_based_and_missing(spark):
    rows = [(1, 1, 2, "a", 0), (1, 2, 2, "z", 0), (1, 2, 2, "b", 1), (2, 0, 2, "x", 0), (3, 2, 2, "x", 0), (3, 3, 2, "y", 0)]
    df = spark.createDataFrame(rows, "multipart_id bigint, part_index int, total_parts int, data string, upload_id bigint").withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))
    got = {r.multipart_id: (r.content, r.error) for r in uploads.concatenate_parts(df).collect()}
    assert got == {1: ("ab", None), 2: (None, "missing part"), 3: (None, "missing part")}  # the newest copy of a part counts


def test_copies_are_dealt_to_all_partitions_before_they_are_cut(spark):
    keys = [(f"users/u/uploads/x/other/doc{i}_humanized.docx",) for i in range(400)] + [(f"users/u/uploads/x/raw/doc{i}.docx",) for i in range(400)]
    stored = spark.createDataFrame(keys, "key string")
    found = catalog.find_derived(stored.filter(F.contains("key", F.lit("/raw/"))), stored)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    copies = [k for k, in keys if "_humanized" in k]
    want = {k: min(c for c in copies if k.split("/")[-1][:-5] in c) for k, in keys if "/raw/" in k}
    assert {r.key: r.alternatives[-1] for r in found.collect()} == want
