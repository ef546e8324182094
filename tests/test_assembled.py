"""Files of assembled uploads: order, copies, gaps, memory."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from docspark.sources import assembled

PARTS = "multipart_id bigint, part_index int, total_parts int, ts timestamp, upload_id bigint, data string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def rows():
    text = {(u, i): f"upload {u} part {i} é日😀 " * (1 + 7 * i) for u in range(1, 8) for i in range(5)}
    out = [(1, i, 3, at(0), i, text[1, i]) for i in (2, 0, 1)]
    out += [(2, i, 2, at(0), i, text[2, i]) for i in (1, 2)]  # from 1 on
    out += [(3, 0, 2, at(0), 0, "old, and longer than the new one " * 30), (3, 0, 2, at(5), 1, text[3, 0]), (3, 1, 2, at(1), 2, text[3, 1]), (3, 0, 2, at(5), 0, "same time, smaller id")]
    out += [(4, i, 4, at(0), i, text[4, i]) for i in (0, 1, 3)] + [(5, i, 3, at(0), i, text[5, i]) for i in (0, 1)] + [(6, 2, 3, at(0), 1, "x")]
    out += [(7, 0, 2, at(0), 0, None), (7, 1, 2, at(0), 1, "")] + [(8, i, 2, at(0), i, "z") for i in range(3)] + [(None, 0, 1, at(0), 0, "nobody's"), (9, None, 1, at(0), 0, "x")]
    return out, text


def test_files_and_manifest(spark, tmp_path):
    parts, text = rows()
    docs = spark.createDataFrame(parts, PARTS).withColumn("_x", F.lit(1)).repartition(5)
    whole = {1: text[1, 0] + text[1, 1] + text[1, 2], 2: text[2, 1] + text[2, 2], 3: text[3, 0] + text[3, 1], 7: ""}
    for block in (1, 10, 10_000):
        folder = str(tmp_path / f"files{block}")
        got = {r.multipart_id: r for r in assembled.write_assembled(assembled.split_blocks(docs, block=block), folder).collect()}
        assert got.keys() == {1, 2, 3, 4, 5, 6, 7, 8}
        for upload, content in whole.items():
            row, data = got[upload], content.encode()
            assert (row.bytes, row.sha256, row.error) == (len(data), hashlib.sha256(data).hexdigest(), None)
            assert open(row.path, "rb").read() == data
        assert {u: (r.missing_index, r.error, r.path) for u, r in got.items() if u not in whole} == {
            4: (2, "missing part", None), 5: (2, "missing part", None), 6: (0, "missing part", None), 8: (None, "too many parts", None)}
        assert sorted(os.listdir(folder)) == ["1.bin", "2.bin", "3.bin", "7.bin", "_drafts"] and not os.listdir(f"{folder}/_drafts")


def test_a_missing_block_is_an_error(spark, tmp_path):
    blocks = assembled.split_blocks(spark.createDataFrame([(1, 0, 1, at(0), 0, "a" * 50), (2, 0, 1, at(0), 0, "b" * 50)], PARTS), block=10)
    got = assembled.write_assembled(blocks.filter("NOT (multipart_id = 1 AND offset = 20)"), str(tmp_path / "f")).collect()
    assert {(r.multipart_id, r.error) for r in got} == {(1, "missing block"), (2, None)}
    twice = assembled.write_assembled(blocks.unionByName(blocks), str(tmp_path / "g")).collect()
    assert {(r.multipart_id, r.bytes, r.error) for r in twice} == {(1, 50, None), (2, 50, None)}


def test_no_uploads(spark, tmp_path):
    assert assembled.write_assembled(assembled.split_blocks(spark.createDataFrame([], PARTS)), str(tmp_path / "f")).count() == 0


def test_an_upload_larger_than_a_cell(spark, tmp_path):
    """2.2 GB in blocks of 1 MB, at most four of which are in a task at once."""
    block, count = 1 << 20, 2200
    blocks = spark.range(count).select(
        F.lit(1).cast("bigint").alias("multipart_id"), F.floor(F.col("id") / 1100).cast("int").alias("part_index"), F.lit(2).alias("total_parts"),
        F.lit(at(0)).alias("ts"), F.lit(1).cast("bigint").alias("upload_id"), (F.col("id") % 1100 * block).alias("offset"),
        F.repeat(F.lpad(F.col("id").cast("string"), 8, "0"), block // 8).alias("data"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 * block)
    try:
        row = assembled.write_assembled(blocks, str(tmp_path / "f")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        digest = hashlib.sha256()
        for i in range(count):
            digest.update(f"{i:08d}".encode() * (block // 8))
        assert (row.bytes, row.sha256, row.error) == (block * count, digest.hexdigest(), None) and os.path.getsize(row.path) == block * count > 2**31
    finally:
        os.unlink(row.path)
