"""Ordered writer of assembled uploads: part contents are appended block by block, so no cell or task holds a whole part."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "multipart_id bigint, total_parts int, parts int, bytes bigint, sha256 string, path string, missing_index int, error string"
#: Characters of a block that long contents are cut into.
BLOCK = 1 << 20


def split_blocks(parts: DataFrame, data_col: str = "data", block: int = BLOCK) -> DataFrame:
    """Rows with a long text in ``data_col`` as several rows: ``offset`` is the block's place in bytes, ``data`` its text. An empty or null one is one empty block."""
    text = F.coalesce(F.col(data_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / block) - 1, F.lit(0)).cast("int"))
    cut = parts.withColumn("_text", text).withColumn("_at", F.explode(starts))
    begin = F.octet_length(F.substring("_text", F.lit(1), F.col("_at") * block)).cast("bigint")
    return cut.withColumn("offset", begin).withColumn("data", F.substring("_text", F.col("_at") * block + 1, F.lit(block))).drop("_text", "_at")


class Assembly:
    """One upload's file while its blocks come by."""

    def __init__(self, files, folder: str, upload: int):
        import hashlib

        self.files, self.upload, name = files, upload, quote(str(upload), safe="")
        self.final, self.draft = f"{folder}/{name}.bin", f"{folder}/_drafts/{name}.{uuid.uuid4().hex}"
        self.out, self.digest = files.open_output_stream(self.draft), hashlib.sha256()
        self.total = self.parts = self.bytes = 0
        self.part = self.copy = self.first = self.missing = self.error = None

    def add(self, part: int, copy: tuple, total: int, offset: int, data: bytes) -> None:
        if part != self.part:
            if self.part is None:
                self.first = part
                self.missing = None if part in (0, 1) else 0
            elif part != self.part + 1 and self.missing is None:
                self.missing = self.part + 1
            self.part, self.copy, self.written = part, copy, 0
            self.parts += 1
            self.total = max(self.total, total)
        elif copy != self.copy:
            return  # the newest copy of a part comes first
        if offset != self.written:
            self.error = "missing block" if offset > self.written else self.error
            return
        if self.missing is None and not self.error:
            self.out.write(data)
            self.digest.update(data)
        self.written += len(data)
        self.bytes += len(data)

    def finish(self) -> tuple:
        """Move the file to its place if it is whole, else drop it; the upload's row of the manifest."""
        self.out.close()
        if self.missing is None and self.parts < self.total:
            self.missing = self.part + 1
        if self.missing is None and self.parts > self.total:
            self.error = "too many parts"
        error = "missing part" if self.missing is not None else self.error
        if error:
            self.files.delete_file(self.draft)
            return self.upload, self.total, self.parts, None, None, None, self.missing, error
        self.files.move(self.draft, self.final)
        return self.upload, self.total, self.parts, self.bytes, self.digest.hexdigest(), self.final, None, None


def _append(folder: str):
    """Task: sorted blocks to files and their manifest rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/_drafts", recursive=True)
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in MANIFEST.split(", "))])
        current, done = None, []

        def manifest():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            upload, part, stamp, sender, total, offset = (batch.column(i).to_pylist() for i in range(6))
            data = batch.column(6)
            for i in range(batch.num_rows):
                if current is None or current.upload != upload[i]:
                    if current is not None:
                        done.append(current.finish())
                    current = Assembly(files, root, upload[i])
                current.add(part[i], (stamp[i], sender[i]), total[i], offset[i], data[i].as_py())
            if len(done) >= 1000:
                yield manifest()
                done.clear()
        if current is not None:
            done.append(current.finish())
        if done:
            yield manifest()

    return task


def write_assembled(blocks: DataFrame, folder: str) -> DataFrame:
    """Write the file of every complete upload to ``folder`` and return the manifest: ``multipart_id, total_parts, parts, bytes, sha256, path, missing_index, error``.

    ``blocks`` holds (multipart_id, part_index, total_parts, ts, upload_id, offset, data): contents of parts, cut into blocks, data as text or
    bytes. Of several copies of a part the newest (ts, upload_id) counts. Indexes start at 0 or 1; where one is missing, or a block is, no file is
    kept and the row says what is missing. ``folder`` is one that all executors reach (a path or URI).

    Blocks are shuffled once by upload and sorted there, and each is appended and forgotten: a task holds one Arrow batch
    (``spark.sql.execution.arrow.maxBytesPerBatch``), whatever the size of an upload. A file gets its name when it is whole, and the manifest,
    written by Spark, names committed files only; a task that runs again writes the same file again.
    """
    order = ["multipart_id", "part_index", F.desc("ts"), F.desc("upload_id"), "offset"]
    rows = blocks.filter("multipart_id IS NOT NULL AND part_index IS NOT NULL").select(
        F.col("multipart_id").cast("bigint"), F.col("part_index").cast("int"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("upload_id").cast("bigint"),
        F.coalesce(F.col("total_parts").cast("int"), F.lit(0)).alias("total_parts"), F.col("offset").cast("bigint"), F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"))
    placed = rows.repartition("multipart_id").sortWithinPartitions(*order)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    ordered = placed.select("multipart_id", "part_index", "ts", "upload_id", "total_parts", "offset", "data")
    return cut_lineage(ordered.mapInArrow(_append(uri), MANIFEST))
