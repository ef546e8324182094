"""DOCX packages: text nodes out, changed node texts back in.

The only per-file Python of the package: unzip, walk the document part, zip again. The
functions handed to Spark carry everything they need, so executors require no installed
package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Files that a task holds as Python objects at a time, however many rows an Arrow batch has.
FILES = 50

NODE_SCHEMA = (
    "path string, para_idx int, node_idx int, node_in_para int, text string, in_table boolean, style string, "
    "is_list boolean, font string, error string"
)


def _in_slices(work, schema: str, files: int = FILES):
    """``work`` on pandas frames as a function on Arrow batches that takes and gives ``files`` rows at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def slices():
            for batch in batches:
                for start in range(0, batch.num_rows, files):
                    yield batch.slice(start, files).to_pandas()

        for frame in work(slices()):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return run


def _map_files(df: DataFrame, work, schema: str) -> DataFrame:
    return df.mapInArrow(_in_slices(work, schema), schema)


def _node_reader():
    def read(batches):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def attribute(parent, *path):
            element = parent
            for tag in path:
                element = element.find(w + tag) if element is not None else None
            return None if element is None else element.get(w + "val")

        def nodes_of(root):
            para_idx, node_idx = -1, 0
            out = []

            def walk(element, para, in_table, font):
                nonlocal para_idx, node_idx
                tag = element.tag
                if tag == w + "tbl":
                    in_table = True
                elif tag == w + "p":
                    para_idx += 1
                    properties = element.find(w + "pPr")
                    para = {
                        "idx": para_idx,
                        "style": attribute(element, "pPr", "pStyle"),
                        "list": properties is not None and properties.find(w + "numPr") is not None,
                        "n": 0,
                    }
                elif tag == w + "r":
                    properties = element.find(w + "rPr")
                    fonts = properties.find(w + "rFonts") if properties is not None else None
                    font = fonts.get(w + "ascii") if fonts is not None else None
                elif tag == w + "t":
                    p = para or {"idx": para_idx, "style": None, "list": False, "n": 0}
                    out.append((p["idx"], node_idx, p["n"], element.text or "", in_table, p["style"], p["list"], font))
                    p["n"] += 1
                    node_idx += 1
                for child in element:
                    walk(child, para, in_table, font)

            walk(root, None, False, None)
            return out

        names = ["para_idx", "node_idx", "node_in_para", "text", "in_table", "style", "is_list", "font"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as package:
                        root = ET.fromstring(package.read("word/document.xml"))
                    rows.extend((path, *node, None) for node in nodes_of(root))
                except Exception as problem:  # noqa: BLE001 - a bad file is a row with its error
                    rows.append((path, None, None, None, None, None, None, None, None, str(problem)))
            frame = pd.DataFrame(rows, columns=["path", *names, "error"])
            for name in ("para_idx", "node_idx", "node_in_para"):
                frame[name] = frame[name].astype("Int32")
            for name in ("in_table", "is_list"):
                frame[name] = frame[name].astype("boolean")
            yield frame

    return read


def read_docx_nodes(blobs: DataFrame) -> DataFrame:
    """One row per text node in document order; an unreadable file gives one row with ``error``."""
    return _map_files(blobs.select("path", "content"), _node_reader(), NODE_SCHEMA)


def _paragraph_reader():
    def read(batches):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as package:
                        root = ET.fromstring(package.read("word/document.xml"))
                    texts = ["".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p")]
                    rows.append((path, texts, None))
                except Exception as problem:  # noqa: BLE001 - a bad file is a row with its error
                    rows.append((path, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "paragraphs", "error"])

    return read


def read_docx_paragraphs(blobs: DataFrame) -> DataFrame:
    """(path, paragraphs, error), one row per file: every paragraph in order, blank ones too; an unreadable file has its error."""
    return _map_files(blobs.select("path", "content"), _paragraph_reader(), "path string, paragraphs array<string>, error string")


def docx_documents(blobs: DataFrame, separator: str = "\n") -> DataFrame:
    """(path, text, error) of every file. A document without text has an empty one; an unreadable file a null text and its error."""
    return read_docx_paragraphs(blobs).select("path", F.array_join("paragraphs", separator).alias("text"), "error")


def docx_text(nodes: DataFrame, separator: str = "\n", by_paragraph: bool = True) -> DataFrame:
    """(path, text): paragraph texts, or all nodes, joined in document order."""
    nodes = nodes.filter("error is null")
    if by_paragraph:
        paras = nodes.groupBy("path", "para_idx").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("node_idx", "text"))), lambda n: n["text"]), ""
            ).alias("text")
        )
        pieces = paras.select("path", F.col("para_idx").alias("pos"), "text")
    else:
        pieces = nodes.filter(F.length("text") > 0).select("path", F.col("node_idx").alias("pos"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return pieces.groupBy("path").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias("text")
    )


def _part_writer():
    def write(batches):
        import io
        import re
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        node = re.compile(r"(<w:t(?:\s[^>]*)?(?<!/)>)(.*?)(</w:t>)|<w:t(?:\s[^>]*)?/>", re.DOTALL)

        def rewritten(content, texts):
            source, target = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
            with source, zipfile.ZipFile(target, "w") as out:
                for item in source.infolist():
                    data = source.read(item.filename)
                    if item.filename == "word/document.xml":
                        position = -1

                        def put(match):
                            nonlocal position
                            position += 1
                            new = texts[position] if position < len(texts) else None
                            if new is None or match.group(1) is None:
                                return match.group(0)
                            return match.group(1) + escape(new) + match.group(3)

                        data = node.sub(put, data.decode("utf-8")).encode("utf-8")
                    out.writestr(item, data, compress_type=item.compress_type)
            return target.getvalue()

        def attempt(content, texts):
            try:
                return (rewritten(content, list(texts)) if texts is not None else content), None
            except Exception as problem:  # noqa: BLE001 - a bad file passes through with its error
                return content, str(problem)

        for batch in batches:
            done = [attempt(c, t) for c, t in zip(batch["content"], batch["texts"])]
            yield pd.DataFrame({
                "path": batch["path"], "content": [c for c, _ in done], "error": pd.array([e for _, e in done], dtype="string")
            })

    return write


def write_docx_parts(blobs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, content, error) with node texts replaced; every other byte and zip member stays.

    ``nodes`` holds (path, node_idx, ``text_col``); files without nodes, and broken ones, pass through.
    """
    ordered = F.sort_array(F.collect_list(F.struct("node_idx", F.col(text_col).alias("t"))))
    texts = nodes.filter("node_idx is not null").groupBy("path").agg(
        F.transform(ordered, lambda n: n["t"]).alias("texts")
    )
    joined = blobs.select("path", "content").join(texts, "path", "left")
    return _map_files(joined, _part_writer(), "path string, content binary, error string")


def _package_builder():
    def build(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        namespace = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        types = (
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/'
            'content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.'
            'relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.'
            'openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
        )
        relations = (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/'
            '2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/officeDocument" Target="word/document.xml"/></Relationships>'
        )
        emphasis = '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr>'

        def package(text):
            body = "".join(
                f"<w:p><w:r>{emphasis if '[REDACTED]' in line else ''}"
                f'<w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
                for line in text.split("\n")
            )
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("[Content_Types].xml", types)
                z.writestr("_rels/.rels", relations)
                z.writestr(
                    "word/document.xml",
                    f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{namespace}"><w:body>{body}'
                    "</w:body></w:document>",
                )
            return out.getvalue()

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [package(t) for t in batch["text"]]})

    return build


def text_to_docx(df: DataFrame) -> DataFrame:
    """(path, text) to (path, content): a new package per text, one paragraph per line, placeholders in bold red."""
    return _map_files(df.select("path", "text"), _package_builder(), "path string, content binary")
