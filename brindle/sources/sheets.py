"""Spreadsheets and word-processor files: both are zipped XML, which the standard library reads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The name spaces of the two formats.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(data: bytes) -> dict[str, str]:
    """The sheets of a workbook in their order, and the part of the archive that holds each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return {s.get("name"): "xl/" + targets[s.get(RELATION)].removeprefix("/xl/") for s in book.iter(f"{SHEET}sheet")}


def _column(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, by name or place, as strings as they are stored; cells that are not there are null."""
    names = sheet_names(data)
    part = names[sheet] if isinstance(sheet, str) else list(names.values())[sheet]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{SHEET}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{SHEET}c")):
                    v, kind = c.find(f"{SHEET}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else v.text if v is not None else None
                    cells[_column(c.get("r")) if c.get("r") else i] = shared[int(text)] if kind == "s" and text is not None else text
                yield [cells.get(i) for i in range(max(cells) + 1)] if cells else []
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of every workbook of a path, all columns strings, named by the first row of the first workbook.

    One workbook is one task's row: the format can't be read in parts.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").first()
    if first is None:
        raise ValueError(f"no workbook in {path}")
    head = next(sheet_rows(bytes(first["content"]), sheet), [])
    names = [n if n else f"Unnamed: {i}" for i, n in enumerate(head)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                found = [(r + [None] * len(names))[: len(names)] for i, r in enumerate(sheet_rows(data.as_py(), sheet)) if i]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(len(names))], names=names)

    return files.select("content").mapInArrow(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of word-processor files: a line for each paragraph."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("content"):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                out.append("\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in body.iter(f"{WORD}p")))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(texts, "path string, text string")
