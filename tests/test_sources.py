"""Files in and out."""

import io
import json
import re
import zipfile

from pyspark.sql import functions as F

from docspark.operators import evaluate, redact
from docspark.sources import docx, evaluation, files, logstore

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(*body):
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/raw.bin", bytes(range(256)), compress_type=zipfile.ZIP_STORED)
    return out.getvalue()


def para(*runs, style=None, listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    body = "".join(f'<w:r>{f}<w:t xml:space="preserve">{t}</w:t></w:r>' for t, f in runs)
    return f"<w:p><w:pPr>{props}</w:pPr>{body}</w:p>"


SYMBOL = '<w:rPr><w:rFonts w:ascii="Symbol"/></w:rPr>'
DOC = package(
    para(("Intro", ""), style="Heading1"),
    para(("NAME: ", ""), ("JOHN DOE", "")),
    f'<w:tbl><w:tr><w:tc>{para(("cell &amp; more", ""))}</w:tc></w:tr></w:tbl>',
    para(("•", SYMBOL), (" item", ""), listed=True),
    "<w:p><w:r><w:t/></w:r></w:p>",
)


def test_docx(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(DOC)
    (tmp_path / "in" / "bad.docx").write_bytes(b"not a zip")
    blobs = files.read_blobs(spark, str(tmp_path / "in"), "*.docx")
    nodes = docx.read_docx_nodes(blobs).cache()
    good = nodes.filter("error is null").orderBy("node_idx").collect()
    assert [n.text for n in good] == ["Intro", "NAME: ", "JOHN DOE", "cell & more", "•", " item", ""]
    assert [n.in_table for n in good] == [False, False, False, True, False, False, False]
    assert good[0].style == "Heading1" and good[4].is_list and good[4].font == "Symbol"
    assert nodes.filter("error is not null").count() == 1
    assert docx.docx_text(nodes).first().text == "Intro\nNAME: JOHN DOE\ncell & more\n• item\n"
    assert docx.docx_text(nodes, by_paragraph=False).first().text.startswith("Intro\nNAME: \nJOHN DOE")
    marked = redact.mark_bullets(nodes.filter("error is null")).filter("is_bullet or symbol_font").collect()
    assert [n.text for n in marked] == ["•"]

    changed = nodes.withColumn("text", F.when(F.col("text") == "JOHN DOE", "A < B").otherwise(F.col("text")))
    files.write_blobs(docx.write_docx_parts(blobs, changed), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in back.collect()}
    assert rows["bad.docx"] == b"not a zip"
    before, after = zipfile.ZipFile(io.BytesIO(DOC)), zipfile.ZipFile(io.BytesIO(rows["a.docx"]))
    assert before.namelist() == after.namelist()
    assert after.read("word/document.xml").decode() == before.read("word/document.xml").decode().replace(
        "JOHN DOE", "A &lt; B")
    assert after.getinfo("word/media/raw.bin").compress_type == zipfile.ZIP_STORED
    texts = [n.text for n in docx.read_docx_nodes(back).filter("error is null").orderBy("node_idx").collect()]
    assert texts[2] == "A < B"
    read = files.read_documents(spark, str(tmp_path / "in"), "docx")
    assert read.filter("error is null").count() == 1 and read.filter("error is not null AND text is null").count() == 1


def test_text_and_listing(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "t" / "sub" / "b.txt").write_text("drei äö", encoding="utf-8")
    listed = files.scan_objects(spark, str(tmp_path / "t"))
    assert {(r.key.rsplit("/", 1)[1], r.size) for r in listed.collect()} == {("a.txt", 8), ("b.txt", 9)}
    texts = files.read_documents(spark, str(tmp_path / "t"), "txt")
    assert {r.text for r in texts.collect()} == {"one\ntwo\n", "drei äö"}
    files.write_txt(texts.filter("text like 'drei%'"), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == "drei äö"


def test_evaluation_files(spark, tmp_path):
    lines = [{"article": f"human {i}", "x": 1, "m_generated_text_wo_prompt": f"machine {i}"} for i in range(4)]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)))
    human, machine = evaluation.read_eval_jsonl(spark, str(tmp_path / "e.jsonl"), "article")
    assert {r.text for r in machine.collect()} == {f"machine {i}" for i in range(4)}
    scores = evaluate.union_scores(
        human.select(F.lit(0.9).alias("score")), machine.select(F.lit(0.2).alias("score"))
    ).withColumn("pred", (F.col("score") < 0.5).cast("int"))
    evaluation.save_experiment(scores, evaluate.evaluate_detector(scores, 0.5), str(tmp_path / "exp"))
    saved = spark.read.option("header", "true").csv(str(tmp_path / "exp" / "score_df"))
    assert saved.count() == 8 and saved.columns == ["score", "class", "pred"]
    assert spark.read.json(str(tmp_path / "exp" / "details")).first().auc == 1.0


def test_log_store(spark, tmp_path):
    logs = spark.sql("select id, timestamp'2024-01-01 23:00:00' + make_interval(0,0,0,cast(id as int)) as created_at "
                     "from range(4)")
    logstore.append_logs(logs, str(tmp_path / "l"))
    logstore.append_logs(logs, str(tmp_path / "l"))
    assert logstore.read_logs(spark, str(tmp_path / "l")).count() == 8
    recent = logstore.read_logs(spark, str(tmp_path / "l"), "2024-01-03")
    assert recent.count() == 4
    assert "PartitionFilters: [isnotnull(log_date" in recent._jdf.queryExecution().toString()


def test_documents_with_blank_paragraphs_and_broken_files(spark):
    texts = spark.createDataFrame([("a", "one\n\ntwo"), ("b", "")], "path string, text string")
    blobs = docx.text_to_docx(texts).unionByName(spark.createDataFrame([("c", bytearray(b"no zip"))], "path string, content binary"))
    got = {r.path: (r.text, r.error is None) for r in docx.docx_documents(blobs).collect()}
    assert got == {"a": ("one\n\ntwo", True), "b": ("", True), "c": (None, False)}
    nodes = docx.read_docx_nodes(blobs).select("path", "node_idx", F.lit("new").alias("text"))
    broken = nodes.filter("node_idx is not null").unionByName(spark.createDataFrame([("c", 0, "x")], nodes.schema))
    out = {r.path: (bytes(r.content)[:6], r.error is None) for r in docx.write_docx_parts(blobs, broken).collect()}
    assert out["c"] == (b"no zip", False) and out["a"][1]


def test_docx_work_goes_in_slices(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(1000)], "text": ["a\nb\nc"] * 1000})
    held = [b.num_rows for b in docx._in_slices(docx._package_builder(), "path string, content binary", 50)([batch])]
    assert held == [50] * 20
    blobs = pa.Table.from_batches(docx._in_slices(docx._package_builder(), "path string, content binary", 50)([batch])).combine_chunks().to_batches()
    nodes = list(docx._in_slices(docx._node_reader(), docx.NODE_SCHEMA, 50)(blobs))
    assert max(b.num_rows for b in nodes) == 150 and sum(b.num_rows for b in nodes) == 3000


def test_redacted_packages_are_read_back_by_paragraph(spark):
    from docspark.plans import QUERIES

    plan = QUERIES["docx_redaction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[path#\d+, para_idx", plan) and "paragraphs" in plan
