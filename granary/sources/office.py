"""Office documents: worksheets and texts out of ZIP containers, one row or many for each file.

A file that can't be read is a row with an error, so one bad upload never ends
a job; ``strict`` raises instead. Entries are parsed as streams, and one larger
than ``most_bytes`` unpacked is an error, as a small archive can hold a huge one.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.schemas import schema_with

MOST_BYTES = 256 << 20
# The name spaces of worksheets, texts and relations.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def entry(archive: zipfile.ZipFile, name: str, most_bytes: int) -> zipfile.ZipExtFile:
    size = archive.getinfo(name).file_size
    if size > most_bytes:
        raise ValueError(f"{name} has {size} bytes, over {most_bytes}")
    return archive.open(name)


def elements(archive: zipfile.ZipFile, name: str, tag: str, most_bytes: int) -> Iterator[ElementTree.Element]:
    """The elements with ``tag`` one after another; what was read is let go."""
    with entry(archive, name, most_bytes) as stream:
        for _, found in ElementTree.iterparse(stream):
            if found.tag == tag:
                yield found
                found.clear()


def place(reference: str | None, last: int) -> int:
    """The column of a cell from 0: that of a reference such as AB12, or the one behind the last."""
    if not reference:
        return last + 1
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None, first_row: int, most_bytes: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, values by column) of a worksheet, by name or the first one, from ``first_row`` on."""
    archive = zipfile.ZipFile(BytesIO(content))
    names = set(archive.namelist())
    sheets = {e.get("name"): e.get(LINK) for e in elements(archive, "xl/workbook.xml", SHEET + "sheet", most_bytes)}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no worksheet {sheet}")
    wanted = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    with entry(archive, "xl/_rels/workbook.xml.rels", most_bytes) as stream:
        target = next(e.get("Target") for e in ElementTree.parse(stream).getroot() if e.get("Id") == wanted)
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = ["".join(t.text or "" for t in e.iter(SHEET + "t")) for e in elements(archive, "xl/sharedStrings.xml", SHEET + "si", most_bytes)] if "xl/sharedStrings.xml" in names else []
    number = 0
    for row in elements(archive, path, SHEET + "row", most_bytes):
        number = int(row.get("r") or number + 1)
        if number < first_row:
            continue
        values: dict[int, str | None] = {}
        at = -1
        for cell in row.iter(SHEET + "c"):
            at = place(cell.get("r"), at)
            kind, value = cell.get("t"), cell.findtext(SHEET + "v")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(SHEET + "t"))
            values[at] = value
        yield number, [values.get(k) for k in range(max(values, default=-1) + 1)]


def worksheets(files: DataFrame, *, sheet: str | None = None, first_row: int = 1, most_bytes: int = MOST_BYTES, strict: bool = False) -> DataFrame:
    """path, row, cells and error from ``path`` and ``content``: a row for each of the sheet's, or one with the error of a bad file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    rows = [(path, n, cells, None) for n, cells in sheet_rows(content.as_py() or b"", sheet, first_row, most_bytes)]
                except Exception as e:
                    if strict:
                        raise
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), 5000):
                    parts = zip(*rows[at : at + 5000], strict=True)
                    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds, strict=True)], names=["path", "row", "cells", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>, error string")


def cell(column: str) -> Column:
    """The trimmed value below a column's letters; null where it is missing or blank."""
    return F.nullif(F.trim(F.get("cells", F.lit(place(column, -1)))), F.lit(""))


def first_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of each key as it stands in the first file and row that have all of them."""
    known = rows.dropna(subset=[*keys, value])
    return known.groupBy(*keys).agg(F.min_by(value, F.struct("path", "row")).alias(value))


def docx_text(content: bytes, most_bytes: int = MOST_BYTES) -> str:
    """The paragraphs of a text, those inside its tables left out, a line each."""
    archive = zipfile.ZipFile(BytesIO(content))
    with entry(archive, "word/document.xml", most_bytes) as stream:
        body = ElementTree.parse(stream).getroot().find(WORD + "body")
    said = {WORD + "tab": "\t", WORD + "br": "\n", WORD + "cr": "\n"}
    return "\n".join("".join(e.text or "" if e.tag == WORD + "t" else said.get(e.tag, "") for e in p.iter()) for p in body.findall(WORD + "p"))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text}


def extracted(uploads: DataFrame, *, name: str = "file_name", content: str = "file_content", encoded: bool = True, extractors: Mapping[str, Callable[[bytes], str]] | None = None, strict: bool = False) -> DataFrame:
    """``uploads`` with ``extracted`` and ``error`` in place of their content (base64 text, or bytes).

    ``extractors`` adds formats by suffix, so a PDF or HWP reader is one
    function. An unknown suffix, content that is no base64, a damaged file and
    a file without visible text have a null text and an error.
    """
    known = {**EXTRACTORS, **(extractors or {})}
    raw = F.try_to_binary(F.col(content), F.lit("base64")) if encoded else F.col(content)
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./]+)$", 1))
    rest = uploads.drop(content, "extracted", "error")
    wide = uploads.select(*rest.columns, suffix.alias("__suffix"), raw.alias("__raw"))
    names = rest.columns

    def text_of(suffix: str, raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            if suffix not in known:
                raise ValueError(f"unsupported file type {suffix}")
            if raw is None:
                raise ValueError("not base64")
            text = known[suffix](raw)
            if not text.strip():
                raise ValueError("no text")
        except Exception as e:
            if strict:
                raise ValueError(str(e)) from e
            return None, str(e)
        return text, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):  # a file at a time: its text may be as large as all the others together
                b = whole.slice(at, 1)
                text, error = text_of(b.column("__suffix")[0].as_py(), b.column("__raw")[0].as_py())
                kept = b.select(names)
                yield kept.append_column("extracted", pa.array([text], pa.string())).append_column("error", pa.array([error], pa.string()))

    return wide.mapInArrow(run, schema_with(rest, "extracted string, error string"))
