"""Identity detection and redaction on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.operators import identity, redact

BASIC = "NAME: SHANMUGAPRIYA SIVAKUMAR\nROLL NUMBER: 25145050010\nPROGRAM: MBA"
FLEXIBLE = "Name: JOHN DOE\nRoll No: 12345678901\nCourse: BCA"
COURSE = BASIC + "\nCOURSE: DMBA114"
NONE = "This is a regular document with no student information."
TRAP = "NAME: CARROLL SMITH\nROLL NO: 2514-5050-010"
SPELLED = "Name: Ann Lee\nRoll No: 123456789012\nalso 12345678-9012, 1234 5678 9012, 12345-6789012; ann lee"


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


@pytest.mark.parametrize("text, name, roll, level", [
    (BASIC, "SHANMUGAPRIYA SIVAKUMAR", "25145050010", "high"),
    (FLEXIBLE, "JOHN DOE", "12345678901", "high"),
    (NONE, None, None, "low"),
    (TRAP, "CARROLL SMITH", "25145050010", "high"),
    ("COURSE CODE & NAME: Finance\nROLL NO: 123", None, None, "low"),
    ("Student Name  Mary Lee\nEnrollment No: 99-88-77-66-5", "Mary Lee", "998877665", "low"),
])
def test_extract(spark, text, name, roll, level):
    row = identity.extract_identity(one(spark, text)).first()
    assert (row.detected_name, row.detected_roll_no, row.extraction_confidence) == (name, roll, level)
    assert (row.excerpt is None) == (name is None and roll is None)


def test_literal_pattern_cuts_names(spark):
    assert identity.extract_identity(one(spark, TRAP), literal=True).first().detected_name == "CAR"


def test_not_strict_is_medium_only(spark):
    row = identity.extract_identity(one(spark, BASIC), strict=False).first()
    assert row.detected_name == "SHANMUGAPRIYA SIVAKUMAR" and row.extraction_confidence == "low"


def test_redact_everywhere(spark):
    row = redact.redact_everywhere(one(spark, COURSE)).first()
    assert fixed.REDACTED in row.redacted_text and "MBA" in row.redacted_text and "DMBA114" in row.redacted_text
    assert "SHANMUGAPRIYA" not in row.redacted_text and "25145050010" not in row.redacted_text
    assert row.redaction_count == 2
    named = redact.redact_everywhere(one(spark, COURSE), remove_roll=False).first()
    assert "25145050010" in named.redacted_text and named.redaction_count == 1


def test_all_written_forms_go(spark):
    row = redact.redact_everywhere(one(spark, SPELLED)).first()
    assert not any(c.isdigit() for c in row.redacted_text) and "ann lee" not in row.redacted_text
    leak = redact.leak_check(redact.redact_everywhere(one(spark, SPELLED))).first()
    assert (leak.name_leaks, leak.roll_leaks, leak.placeholders) == (0, 0, 6)


def test_redaction_is_idempotent(spark):
    once = redact.redact_everywhere(one(spark, COURSE)).select("doc_id", F.col("redacted_text").alias("text"))
    twice = redact.redact_everywhere(once).first()
    assert twice.redacted_text == once.first().text


def test_labels_survive(spark):
    kept = redact.redact_field(one(spark, COURSE), preserve_label=True).first().redacted_text
    assert "NAME: [REDACTED]" in kept and "ROLL NUMBER: [REDACTED]" in kept
    bare = redact.redact_field(one(spark, COURSE)).first().redacted_text
    assert bare.startswith("[REDACTED]\n[REDACTED]\nPROGRAM")


def test_clear_after_label(spark):
    text = "• intro\nNAME: A B\nCOURSE CODE & NAME: Finance\n ROLL NUMBER : 12345678\nend"
    out = redact.clear_after_label(one(spark, text)).first().cleared_text
    assert out == "• intro\nNAME: \nCOURSE CODE & NAME: Finance\n ROLL NUMBER : \nend"


def test_caller_patterns(spark):
    row = redact.anonymize_by_pattern(one(spark, "Ann Lee 1234567 ann lee 1234567")).first()
    assert (row.detected_name, row.detected_roll_no, row.anonymized_text) == ("Ann Lee", "1234567", "   ")


def test_batch_isolates_bad_rows(spark):
    df = spark.createDataFrame([(1, BASIC), (2, " "), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.status for r in redact.redact_batch(df).collect()}
    assert got == {1: "success", 2: "error", 3: "error"}


NODES = [
    ["NAME:", "12", "99", "JOHN DOE", "ROLL NO", "123456"],
    ["Author Jane Roe", "nothing", "ID: 7654321"],
    ["The Quick Brown", "no numbers"],
    ["lower case only"],
    ["Mary Major", "x", "roll no: 555666777", "Peter Minor"],
]


def nodes_frame(spark):
    return spark.createDataFrame(list(enumerate(NODES)), "doc_id bigint, nodes array<string>")


def test_short_walk(spark):
    got = {r.doc_id: r for r in identity.detect_identity_nodes(nodes_frame(spark)).collect()}
    assert (got[0].name, got[0].roll_no, got[0].confidence, got[0].name_evidence) == (
        "JOHN DOE", "123456", "HIGH", "label")
    assert (got[1].name, got[1].roll_no, got[1].roll_evidence) == ("Jane Roe", "7654321", "regex")
    assert (got[2].name, got[2].roll_no, got[2].confidence) == ("The Quick", None, "LOW")
    assert got[3].confidence == "CLEAN"


def test_full_walk_and_policy(spark):
    found = identity.removal_policy(identity.detect_identity_proximity(nodes_frame(spark)))
    got = {r.doc_id: r for r in found.collect()}
    assert (got[0].name, got[0].confidence) == ("12", "HIGH")
    assert (got[4].name, got[4].roll_no, got[4].confidence) == ("Mary Major", "555666777", "MEDIUM")
    assert got[4].remove_name and got[4].remove_roll_no
    assert got[2].confidence == "LOW" and not got[2].remove_name


def test_verify_report(spark):
    row = redact.redact_and_verify(spark.createDataFrame(
        [(1, ["NAME:", "JOHN DOE", "ROLL NO:", "1234567", "text", "john doe"])], "doc_id bigint, nodes array<string>"
    )).first()
    assert (row.name_before, row.roll_before, row.removed_name, row.removed_roll) == ("JOHN DOE", "1234567", 2, 1)
    assert row.bytes_removed == len("JOHN DOE") * 2 + 7 - 3 * 2 and row.roll_after is None


def test_labels_across_block_borders(spark):
    rows = [(1, i, f"text {i}") for i in range(3 * identity.BLOCK)]
    for label in (identity.BLOCK - 1, 2 * identity.BLOCK - 2):
        rows[label] = (1, label, "NAME:")
        rows[label + 1] = (1, label + 1, "7")
        rows[label + 2] = (1, label + 2, f"PERSON {label}")
    nodes = spark.createDataFrame(rows, "doc_id bigint, node_idx int, text string")
    hits = identity.label_then_value(nodes)
    assert {(r.node_idx, r.value) for r in hits.collect()} == {
        (n, f"PERSON {n}") for n in (identity.BLOCK - 1, 2 * identity.BLOCK - 2)}
    assert identity.first_per_document(hits).first().node_idx == identity.BLOCK - 1


def test_tagged_value(spark):
    xml = '<w:t xml:space="preserve">JOHN DOE</w:t><w:t>x JOHN DOE</w:t>'
    df = spark.createDataFrame([(xml, "John Doe", "zz")], "x string, v string, w string")
    row = df.select(
        redact.clear_tagged_value(F.col("x"), F.col("v")).alias("a"),
        redact.clear_tagged_value(F.col("x"), F.lit("x JOHN"), "", raw_fallback=True).alias("b"),
        redact.clear_tagged_value(F.col("x"), F.lit("  ")).alias("c"),
    ).first()
    assert row.a == '<w:t xml:space="preserve"> </w:t><w:t>x JOHN DOE</w:t>'
    assert row.b == '<w:t xml:space="preserve">JOHN DOE</w:t><w:t> DOE</w:t>' and row.c == xml


def test_names_with_regex_marks(spark):
    from docspark.functions.expr import replace_ignoring_case

    df = spark.createDataFrame([("a (b) A (B) $1 a", "A (b)")], "t string, v string")
    assert df.select(replace_ignoring_case(F.col("t"), F.col("v"), "$x").alias("o")).first().o == "$x $x $1 a"


def test_term_rows_carry_no_text(spark):
    """Texts are lower-cased and counted before a document becomes a row per term."""
    df = spark.createDataFrame([(1, "The NAME the name", "the [X]"), (2, "", None), (3, None, "the")], "doc_id bigint, b string, a string")
    counted = redact.term_counts(df, "b", "a", ["Name", "the", ""])
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan[:plan.index("Generate")]
    got = {(r.doc_id, r.term): (r.before, r.after, r.delta) for r in counted.collect()}
    assert got == {(1, "Name"): (2, 0, -2), (1, "the"): (2, 1, -1), (1, ""): (0, 0, 0), (2, "Name"): (0, None, None), (2, "the"): (0, None, None),
                   (2, ""): (0, 0, 0), (3, "Name"): (None, 0, None), (3, "the"): (None, 1, None), (3, ""): (0, 0, 0)}
