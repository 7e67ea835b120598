"""File trees as inventories, and texts of files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P

TEXT_EXTENSIONS = (".txt", ".md")
#: Files whose contents are unpacked or packed at once.
ROWS = 200
#: Where a word-processor file holds its text, the names of its elements, and the most bytes of it that are unpacked.
PART, SPACE, MOST_PART = "word/document.xml", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", 256 << 20


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """The files below a root as inventory rows (path, size, mtime, name, parent, ext); listing is Spark's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    name = P.name_of(path)
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("_m"), *(["content"] if content else []))
    return rows.withColumn("mtime", F.col("_m") / 1e6).drop("_m").withColumns({"name": name, "parent": P.parent_of(path), "ext": P.ext_of(name), "is_dir": F.lit(False)})


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of text files; undecodable bytes become replacement marks, other kinds have no text."""

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    decoded = F.pandas_udf(decode, "string")
    return files.select("path", F.when(F.col("ext").isin(*TEXT_EXTENSIONS), decoded("content")).alias("text"))


def paragraphs(content: bytes) -> tuple[str | None, str | None]:
    """The paragraphs of a .docx file, a line each, or the reason why there are none.

    Those of the body count, not those within tables; tabs and breaks of a run stay.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo(PART).file_size > MOST_PART:
                return None, "too_large"
            raw = z.read(PART)
    except zipfile.BadZipFile:
        return None, "not_a_package"
    except KeyError:
        return None, "no_text_part"
    except (OSError, RuntimeError, NotImplementedError, EOFError, ValueError, zlib.error) as e:
        return None, type(e).__name__
    if b"<!DOCTYPE" in raw:
        return None, "declares_a_type"  # such files have none, and its entities could grow without end
    try:
        body = ElementTree.fromstring(raw).find(f"{SPACE}body")
    except ElementTree.ParseError:
        return None, "malformed"
    if body is None:
        return None, "no_body"
    marks = {f"{SPACE}tab": "\t", f"{SPACE}br": "\n", f"{SPACE}cr": "\n"}
    lines = []
    for p in body.findall(f"{SPACE}p"):
        runs = (e for r in p.iter(f"{SPACE}r") for e in r)
        lines.append("".join(e.text or "" if e.tag == f"{SPACE}t" else marks.get(e.tag, "") for e in runs))
    return "\n".join(lines), None


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only those are held as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def document_texts(files: DataFrame) -> DataFrame:
    """(path, text, reason) of files (path, ext, content): the text, or null and the reason why there is none.

    Text files are decoded with replacement marks; of .docx files come the paragraphs; other
    kinds are ``unsupported``, rows without content ``unreadable``. One broken file is a
    row with its reason, not a failed task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for ext, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if content is None:
                    out.append((None, "unreadable"))
                elif ext in TEXT_EXTENSIONS:
                    out.append((content.decode("utf-8", "replace"), None))
                elif ext == ".docx":
                    out.append(paragraphs(content))
                else:
                    out.append((None, "unsupported"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([r for _, r in out], pa.string())], names=["path", "text", "reason"])

    return files.select("path", "ext", F.col("content").cast("binary")).mapInArrow(run, "path string, text string, reason string")


def packed(texts: DataFrame) -> DataFrame:
    """(path, content): texts (path, text) as .docx files, a paragraph for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{SPACE[1:-1]}"><w:body>'
        for batch in small(batches):
            out = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(PART), f"{head}{body}</w:body></w:document>")
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return texts.select("path", "text").mapInArrow(run, "path string, content binary")
