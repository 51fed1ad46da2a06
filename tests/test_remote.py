"""Paged services over HTTP and as streams; relational tables."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from granary.sources import databases, paged


class Pages(BaseHTTPRequestHandler):
    """/number: the page as the test says, or 500."""

    asked: Counter = Counter()
    pages: dict[int, bytes | None] = {}

    def do_GET(self):
        number = int(self.path.rsplit("/", 1)[-1])
        self.asked[number] += 1
        body = self.pages.get(number, b'{"data": []}')
        self.send_response(500 if body is None else 200)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        pass


@pytest.fixture()
def service():
    Pages.asked, Pages.pages = Counter(), {}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{page}}"
    server.shutdown()


def json_page(ids, total=None):
    return json.dumps({"data": [{"pbanc_sn": str(i), "rcrt_prgs_yn": "Y" if i % 2 else "N", "n": i} for i in ids]} | ({} if total is None else {"total_count": total})).encode()


def xml_page(ids, total):
    items = "".join(f'<item><col name="pbanc_sn"> {i} </col><rcrt_prgs_yn>Y</rcrt_prgs_yn></item>' for i in ids)
    return f"<r><totalCount>{total}</totalCount>{items}</r>".encode()


def ids_of(df):
    return sorted(int(r["id"]) for r in df.collect())


def test_a_page_is_xml_or_json():
    assert paged.parse(xml_page([3], 9)) == (9, [{"pbanc_sn": "3", "rcrt_prgs_yn": "Y"}])
    assert paged.parse(b'[{"a": 1, "b": null, "c": {"d": "\xc3\xa9"}}]') == (None, [{"a": "1", "b": None, "c": '{"d": "é"}'}])
    assert paged.parse(b'{"total_count": 4}') == (4, [])
    with pytest.raises(json.JSONDecodeError):
        paged.parse(b"<r><item>")


@pytest.mark.parametrize("fault, kept", [(None, range(10)), ("error", range(6)), ("empty", range(6)), ("short", range(8))])
def test_items_up_to_the_first_fault(spark, service, tmp_path, fault, kept):
    Pages.pages = {p: (xml_page if p == 2 else json_page)(range(3 * p - 3, min(10, 3 * p)), 10) for p in (1, 2, 3, 4)}
    Pages.pages |= {"error": {3: None}, "empty": {3: json_page([], 10)}, "short": {3: json_page([6, 7], 10)}}.get(fault, {})
    landed = paged.land(spark, service, str(tmp_path / "landed"), size=3)
    assert landed.select("page").distinct().count() == 4
    found = paged.announcements(paged.complete(landed, 3), id_key="pbanc_sn", open_key="rcrt_prgs_yn", only_open=False)
    assert ids_of(found) == list(kept)
    assert Pages.asked == {1: 2, 2: 1, 3: 1, 4: 1}  # the first also tells the total


def test_open_items_with_ids_in_order(spark, service, tmp_path):
    Pages.pages = {1: json_page([4, 3, 1], 5), 2: json_page([7, 5], 5)}
    items = paged.complete(paged.land(spark, service, str(tmp_path / "landed"), size=3), 3)
    how = {"id_key": "pbanc_sn", "open_key": "rcrt_prgs_yn"}
    assert ids_of(paged.announcements(items, **how)) == [1, 3, 5, 7]
    assert ids_of(paged.announcements(items, count=2, **how)) == [1, 3]
    assert paged.announcements(items, id_key="none", open_key="rcrt_prgs_yn").count() == 0


def test_a_service_without_a_total_is_read_to_the_last_page_allowed(spark, service, tmp_path):
    Pages.pages = {1: json_page([0, 1]), 2: json_page([2, 3]), 3: json_page([4])}
    landed = paged.land(spark, service, str(tmp_path / "landed"), size=2, pages=6)
    assert landed.filter("item IS NOT NULL").count() == 5 and paged.complete(landed, 2).count() == 5


def test_a_service_that_is_down_is_one_row_with_an_error(spark, service, tmp_path):
    Pages.pages = {1: None}
    row = paged.land(spark, service, str(tmp_path / "landed"), size=2).collect()
    assert [(r["page"], r["item"]) for r in row] == [(1, None)] and "HTTPError" in row[0]["error"]


def test_pages_that_a_filter_rules_out_are_not_asked_for(spark, service):
    Pages.pages = {p: json_page([p], 6) for p in range(1, 7)}
    paged.register(spark)
    df = spark.read.format(paged.FORMAT).options(url=service, size=1).load().filter("page >= 3 AND page < 5 AND place = 0")
    assert sorted(r["page"] for r in df.collect()) == [3, 4]
    assert set(Pages.asked) == {1, 3, 4}


def collect(spark, service, target, progress):
    stream = spark.readStream.format(paged.FORMAT).options(url=service, size=3).load()
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def test_a_killed_stream_gives_each_item_once(spark, service, tmp_path):
    paged.register(spark)
    target, progress = str(tmp_path / "items"), str(tmp_path / "progress")
    held = lambda: sorted(int(r[0]) for r in spark.read.schema(paged.SCHEMA).parquet(target).select(F.element_at("item", "pbanc_sn")).collect())
    Pages.pages = {1: json_page([0, 1, 2], 5), 2: json_page([3, 4], 5)}
    collect(spark, service, target, progress)
    assert held() == [0, 1, 2, 3, 4]
    Pages.pages = {1: json_page([0, 1, 2], 11), 2: json_page([3, 4, 5], 11), 3: None, 4: json_page([9, 10], 11)}
    with pytest.raises(StreamingQueryException):
        collect(spark, service, target, progress)
    assert held() == [0, 1, 2, 3, 4]  # nothing of the batch that failed
    Pages.pages[3] = json_page([6, 7, 8], 11)
    asked = Pages.asked[1]
    collect(spark, service, target, progress)
    assert held() == list(range(11))
    collect(spark, service, target, progress)
    assert held() == list(range(11))
    assert Pages.asked[2] == 3  # page 2 was fetched for the first run, the failed and the good one; page 1 only for totals
    assert Pages.asked[1] > asked


def test_bounds_come_from_the_table(spark):
    url = databases.scratch_database(spark)
    rows = spark.createDataFrame([(k if k % 7 else None, f"v{k}") for k in range(1, 101)], "k long, v string")
    databases.write_table(rows, url, "t")
    df = databases.read_table(spark, url, "t", key="k", partitions=5)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(str, df.collect())) == sorted(map(str, rows.collect()))
    plan = df.filter("k > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,90)" in plan


def test_aggregates_of_a_catalog_go_to_the_database(spark, sf):
    from granary import plans

    plan = plans.QUERIES["s18_pushed_query"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # nothing is left for Spark to add up


def test_an_empty_table_is_one_partition(spark):
    url = databases.scratch_database(spark)
    databases.write_table(spark.createDataFrame([], "k long"), url, "t")
    df = databases.read_table(spark, url, "t", key="k")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 0


def test_tasks_out_of_reach_of_the_driver_ask_their_own_databases(spark, sf, monkeypatch):
    from granary import plans

    names = ("s18_relational_scan", "s18_pushed_query")
    answers = lambda: [sorted(map(tuple, plans.QUERIES[name](spark, sf).collect())) for name in names]
    wanted = answers()
    monkeypatch.setattr(databases, "one_process", lambda spark: False)
    monkeypatch.setattr(databases, "SHARD", 400)
    monkeypatch.setattr(databases, "scratch_database", None)  # a call fails
    assert answers() == wanted


def test_shards_keep_kinds_and_odd_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.5, "a'b"), (2, float("nan"), None), (None, None, ""), (4, float("inf"), "x")], "k long, v double, t string")
    databases.write_shards(rows, f"{tmp_path}/images", "t")
    found = databases.ask_shards(spark, f"{tmp_path}/images", "SELECT k, v, t FROM t", rows.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    above = databases.ask_shards(spark, f"{tmp_path}/images", "SELECT k FROM t WHERE v > 2", "k long")
    assert sorted(r.k for r in above.collect()) == [2, 4]
