"""Office files and rotated logs that tasks write from given tables and the library reads back."""

from __future__ import annotations

import base64
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.sources import files, office, shipping

WORKBOOK_ROWS = 500


def zipped(entries: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            archive.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def workbook(rows: list[dict[str, object]], first_row: int, sheet: str) -> bytes:
    """A workbook with two sheets; values of the second stand below their column letters, texts shared, numbers as such."""
    shared: dict[str, int] = {}
    lines = []
    for n, row in enumerate(rows, first_row):
        cells = [f'<c r="{c}{n}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{n}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>' for c, v in row.items() if v is not None]
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    space = office.SHEET.strip("{}")
    links = office.LINK[1:].split("}")[0]
    page = lambda body: f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>'
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{links}"><sheets><sheet name="cover" r:id="rId1"/><sheet name="{escape(sheet)}" r:id="rId2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{space}">{"".join(f"<si><t>{escape(x)}</t></si>" for x in shared)}</sst>',
            "xl/worksheets/sheet1.xml": page('<row r="6"><c r="Q6" t="inlineStr"><is><t>cover</t></is></c></row>'),
            "xl/worksheets/sheet2.xml": page('<row r="1"><c r="A1" t="inlineStr"><is><t>heading</t></is></c></row>' + "".join(lines)),
        }
    )


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """path and content: parts, five hundred to a workbook, from row 6 on; every workbook is a row as a reader of binary files gives it."""
    rows = table(spark, d, "part").select((F.col("p_partkey") / WORKBOOK_ROWS).cast("int").alias("book"), F.struct("p_partkey", "p_brand", "p_name", "p_size", "p_type").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books = []
            for parts in b.column("r").to_pylist():
                books.append(workbook([{"Q": p["p_brand"], "R": f" {p['p_name']} ", "U": p["p_size"] if p["p_partkey"] % 13 else None, "V": p["p_type"]} for p in parts], 6, "codes"))
            yield pa.RecordBatch.from_arrays([pa.array([f"book{k:09d}.xlsx" for k in b.column("book").to_pylist()]), pa.array(books, pa.binary())], names=["path", "content"])

    return rows.groupBy("book").agg(F.array_sort(F.collect_list("r")).alias("r")).mapInArrow(run, "path string, content binary")


@query(
    """SELECT 'major' AS level, p_brand AS code, CAST(NULL AS VARCHAR) AS minor, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_brand
    UNION ALL SELECT 'minor', p_brand, lpad(CAST(p_size AS VARCHAR), 3, '0'), arg_min(p_type, p_partkey) FROM part WHERE p_partkey % 13 > 0 GROUP BY p_brand, p_size"""
)
def s07_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of codes from columns by their place; of each code the first name counts."""
    rows = office.worksheets(workbooks(spark, d), sheet="codes", first_row=6)
    cells = rows.filter("error IS NULL").select("path", "row", office.cell("Q").alias("code"), office.cell("R").alias("major"), F.lpad(office.cell("U"), 3, "0").alias("minor"), office.cell("V").alias("name"))
    majors = office.first_values(cells, ["code"], "major").select(F.lit("major").alias("level"), "code", F.lit(None).cast("string").alias("minor"), F.col("major").alias("name"))
    return majors.unionByName(office.first_values(cells, ["code", "minor"], "name").select(F.lit("minor").alias("level"), "code", "minor", "name"))


def document(text: str) -> bytes:
    space = office.WORD.strip("{}")
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    return zipped({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{lines}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads; some have another suffix, and some content is no file or no base64."""
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F￾￿]", " ").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            bodies = [b"no archive" if i % 10 == 5 else document(t.as_py()) for i, t in zip(ids, b.column("text"), strict=True)]
            coded = ["%%" if i % 10 == 7 else base64.b64encode(x).decode() for i, x in zip(ids, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f"Upload {i}.{'hwp' if i % 10 == 3 else 'DOCX'}" for i in ids]), pa.array(coded, pa.string())], names=["doc_id", "file_name", "file_content"])

    return rows.mapInArrow(run, "doc_id long, file_name string, file_content string")


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', ' ', 'g') AS text FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (3, 5, 7) AND regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') THEN md5(text) END AS text_md5,
    CASE doc_id % 10 WHEN 3 THEN 'unsupported file type .hwp' WHEN 5 THEN 'File is not a zip file' WHEN 7 THEN 'not base64'
        ELSE CASE WHEN NOT regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') THEN 'no text' END END AS error FROM t"""
)
def s14_uploads(spark: SparkSession, d: str) -> DataFrame:
    found = office.extracted(uploads(spark, d))
    return found.select("doc_id", F.md5(F.col("extracted").cast("binary")).alias("text_md5"), "error")


@query("SELECT 'shop' AS service, CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events")
def k07_shipped_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs that rotate in two rounds, shipped by two runs; the first run's files go to the archive in the second."""
    folder, target, progress, archive = (files.scratch(spark, x) for x in ("logs", "shipped", "progress", "archive"))
    events = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_id", "event_type").alias("value"))
    for k in range(2):
        rotated(events.filter(F.col("event_id") % 2 == k).select("value"), folder, k)
        shipping.ship(spark, folder, target, progress, archive=archive).awaitTermination()
    return spark.read.parquet(target).select("service", F.col("value").alias("line"))


def rotated(lines: DataFrame, folder: str, turn: int) -> None:
    """Lines as files ``shop.log.<turn>-<part>``, which tasks write; a task that runs again writes the same file."""
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/shop.log.{turn}-{TaskContext.get().partitionId()}") as out:
            for b in batches:
                out.write("".join(x + "\n" for x in b.column("value").to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["files"])

    lines.mapInArrow(run, "files int").agg(F.sum("files")).collect()
