"""Worksheets, texts of uploads, and rotated logs."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from granary.plans import office_queries as made
from granary.sources import office, shipping


def test_cells_by_place():
    assert [office.place(x, 4) for x in ("A1", "Z9", "AA3", "AB12", None)] == [0, 25, 26, 27, 5]
    book = made.workbook([{"B": "x & y", "D": 7}, {"A": None}], 2, "s<1>")
    assert list(office.sheet_rows(book, "s<1>", 1, 1 << 20)) == [(1, ["heading"]), (2, [None, "x & y", None, "7"]), (3, [])]
    assert list(office.sheet_rows(book, None, 1, 1 << 20)) == [(6, [None] * 16 + ["cover"])]


def test_bad_workbooks_are_rows_with_an_error(spark):
    good = made.workbook([{"A": "v"}], 6, "codes")
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"junk")), ("c", None), ("d", bytearray(made.zipped({"x": "y"}))), ("e", bytearray(made.workbook([], 6, "other")))], "path string, content binary")
    rows = {r.path: (r.row, r.cells, r.error) for r in office.worksheets(df, sheet="codes", first_row=6).collect()}
    assert rows["a"] == (6, ["v"], None)
    assert all(rows[p][:2] == (None, None) and part in rows[p][2] for p, part in (("b", "BadZipFile"), ("c", "BadZipFile"), ("d", "KeyError"), ("e", "no worksheet codes")))
    large = {r.path: r.error for r in office.worksheets(df.filter("path = 'a'"), sheet="codes", most_bytes=50).collect()}
    assert "over 50" in large["a"]
    with pytest.raises(PythonException):
        office.worksheets(df, strict=True).collect()


def test_the_first_row_of_the_first_file_wins(spark):
    df = spark.createDataFrame([("b", 1, "k", "late"), ("a", 9, "k", "first"), ("a", 8, "k", None), ("a", 2, None, "x")], "path string, row int, k string, v string")
    assert [tuple(r) for r in office.first_values(df, ["k"], "v").collect()] == [("k", "first")]


def test_uploads(spark):
    text = "one\n  two\tthree & <four>\n"
    coded = __import__("base64").b64encode(made.document(text)).decode()
    df = spark.createDataFrame([("a.docx", coded, 1), ("b.pdf", coded, 2), ("noext", coded, 3), (None, None, 4), ("c.docx", None, 5)], "file_name string, file_content string, error int")
    got = {r.file_name: (r.extracted, r.error) for r in office.extracted(df).collect()}
    assert got == {"a.docx": (text, None), "b.pdf": (None, "unsupported file type .pdf"), "noext": (None, "unsupported file type "), None: (None, "unsupported file type "), "c.docx": (None, "not base64")}
    more = office.extracted(df, extractors={".pdf": lambda raw: f"{len(raw)} bytes"}).filter("file_name = 'b.pdf'").first()
    assert more.extracted.endswith(" bytes") and more.error is None
    with pytest.raises(PythonException, match="unsupported file type"):
        office.extracted(df, strict=True).collect()


def test_logs_are_shipped_once_and_archived(spark, tmp_path):
    folder, archive = tmp_path / "logs", tmp_path / "archive"
    folder.mkdir()
    for name, body in (("shop.log.1", "a\nb\n"), ("web.log.1", "c\n"), ("shop.log", "open\n")):
        (folder / name).write_text(body)
    plan = sorted((r.key.split("/")[0], r.key.split("/")[2], r.bytes) for r in shipping.planned(spark, str(folder)).collect())
    assert plan == [("shop", "shop.log.1", 4), ("web", "web.log.1", 2)]
    assert shipping.planned(spark, str(folder), service="web").count() == 1
    run = lambda: shipping.ship(spark, f"file://{folder}", str(tmp_path / "out"), str(tmp_path / "cp"), archive=f"file://{archive}").awaitTermination()
    run()
    (folder / "shop.log.2").write_text("d\n")
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.service, r.value, r.file_name) for r in found.collect()) == [("shop", "a", "shop.log.1"), ("shop", "b", "shop.log.1"), ("shop", "d", "shop.log.2"), ("web", "c", "web.log.1")]
    assert found.select(F.length("day")).distinct().first()[0] == 10
    assert {p.name for p in archive.rglob("*.log.*") if not p.name.startswith(".")} == {"shop.log.1", "web.log.1"}
    assert (folder / "shop.log").exists() and (folder / "shop.log.2").exists()
