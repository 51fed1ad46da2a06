"""Paged services as a batch and a streaming source.

A page is an input partition, so executors fetch pages side by side, and the
driver asks for one page only, to learn the total. The same format streams: an
offset is the number of items read so far, kept in the query's checkpoint, so a
restarted query goes on behind the last item it committed, and a page that was
short the last time is read on from where it ended.
"""

from __future__ import annotations

import json
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "paged_rest"
SCHEMA = "page int, n_items int, place int, item map<string,string>, error string"
SIZE, MOST_PAGES = 500, 100


def fetch(url: str, timeout: float) -> bytes:
    """The bytes behind ``url``: over HTTP, or from any store that Arrow reads; a folder is its data files one after another."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read()
    store, path = fs.FileSystem.from_uri(url)
    files = [path]
    if store.get_file_info(path).type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(path))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return b"".join(store.open_input_stream(f).readall() for f in files)


def as_text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def parse(body: bytes) -> tuple[int | None, list[dict[str, str | None]]]:
    """(total as the service states it, items) of an XML page, or else of a JSON one: {"data": [...]} or a list."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        page = json.loads(body)
        envelope, items = (page, page.get("data") or []) if isinstance(page, dict) else ({}, page)
        total = envelope.get("total_count", envelope.get("totalCount"))
        return None if total is None else int(total), [{k: as_text(v) for k, v in x.items()} for x in items]
    total = next((e.text for e in root.iter() if e.tag in ("totalCount", "total_count")), None)
    rows = [{e.get("name") or e.tag: (e.text or "").strip() for e in item} for item in root.iter("item")]
    return None if total is None else int(total), rows


class Page(InputPartition):
    """The items ``first`` to ``last`` (exclusive; None: all) of a page."""

    def __init__(self, number: int, first: int = 0, last: int | None = None) -> None:
        self.number, self.first, self.last = number, first, last


class Service:
    """What the options say: ``url`` with {page} and {size}, ``size``, ``pages`` (at most), ``timeout`` in seconds."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.url, self.size = options["url"], int(options.get("size", SIZE))
        self.most, self.timeout = int(options.get("pages", MOST_PAGES)), float(options.get("timeout", 60))

    def page(self, number: int) -> tuple[int | None, list[dict[str, str | None]]]:
        return parse(fetch(self.url.format(page=number, size=self.size), self.timeout))


class PagedReader(DataSourceReader):
    """One partition a page; comparisons of ``page`` with constants leave out the pages that they rule out."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.service, self.wanted = Service(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: lambda v: lambda p: p == v, GreaterThan: lambda v: lambda p: p > v, GreaterThanOrEqual: lambda v: lambda p: p >= v, LessThan: lambda v: lambda p: p < v, LessThanOrEqual: lambda v: lambda p: p <= v, In: lambda v: lambda p: p in v}
        for f in filters:
            if type(f) in tests and f.attribute == ("page",):
                self.wanted.append(tests[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        try:
            total, _ = self.service.page(1)
        except Exception:  # the first page's own task reports it
            total = 1
        n = self.service.most if total is None else min(self.service.most, max(1, -(-total // self.service.size)))
        return [Page(p) for p in range(1, n + 1) if all(test(p) for test in self.wanted)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A row for each item; a page without items, or with an error, is one row without an item."""
        try:
            _, items = self.service.page(partition.number)
        except Exception as e:
            yield partition.number, 0, None, None, f"{type(e).__name__}: {e}"
            return
        if not items:
            yield partition.number, 0, None, None, None
        for k, item in enumerate(items):
            yield partition.number, len(items), k, item, None


class PagedStreamReader(DataSourceStreamReader):
    """Offsets count items; the pages between two offsets are read by tasks, and a broken page fails its batch, which is tried again."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.service = Service(options)

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        total, items = self.service.page(1)
        return {"items": len(items) if total is None else total}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        size, a, b = self.service.size, start["items"], end["items"]
        return [Page(p + 1, max(0, a - p * size), min(size, b - p * size)) for p in range(a // size, -(-b // size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        _, items = self.service.page(partition.number)
        if len(items) < partition.last:
            raise ValueError(f"page {partition.number} has {len(items)} items in place of {partition.last}")
        for k in range(partition.first, partition.last):
            yield partition.number, len(items), k, items[k], None

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; push-down to Python sources is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def land(spark: SparkSession, url: str, path: str, *, size: int = SIZE, pages: int = MOST_PAGES) -> DataFrame:
    """Fetch every page once and keep what came as a table at ``path``."""
    register(spark)
    spark.read.format(FORMAT).options(url=url, size=size, pages=pages).load().write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def complete(landed: DataFrame, size: int = SIZE) -> DataFrame:
    """The items that reading page after page gives: all before the first broken or empty page, none behind a short one."""
    broken = F.min(F.when(F.col("error").isNotNull() | (F.col("n_items") == 0), F.col("page")))
    short = F.min(F.when(F.col("n_items") < size, F.col("page")))
    end = landed.agg(broken.alias("broken"), short.alias("short")).first()
    kept = landed.filter(F.col("item").isNotNull())
    if end["broken"] is not None:
        kept = kept.filter(F.col("page") < end["broken"])
    return kept if end["short"] is None else kept.filter(F.col("page") <= end["short"])


def announcements(items: DataFrame, *, id_key: str, open_key: str, open_value: str = "Y", only_open: bool = True, count: int = 0) -> DataFrame:
    """Items that have an id, with it as column ``id``; those still open unless ``only_open`` is off; the first ``count`` in the order of the service (0: all)."""
    found = items.withColumn("id", F.try_element_at("item", F.lit(id_key))).filter(F.coalesce(F.col("id"), F.lit("")) != "")
    if only_open:
        found = found.filter(F.try_element_at("item", F.lit(open_key)) == open_value)
    return found.orderBy("page", "place").limit(count) if count else found


def write_pages(rows: DataFrame, path: str, *, order: str, page: str, size: int, xml: str | None = None) -> None:
    """Rows as the pages of a service, in a folder for each: JSON envelopes, or XML where the boolean column ``xml`` says so.

    ``page`` numbers the pages from 1 and gives each at most ``size`` rows.
    """
    fields = [c for c in rows.columns if c not in (page, xml)]
    escaped = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    as_xml = F.concat(F.lit("<item>"), *[F.concat(F.lit(f'<col name="{c}">'), escaped(c), F.lit("</col>")) for c in fields], F.lit("</item>"))
    flag = F.col(xml) if xml else F.lit(False)
    bodies = rows.select(page, flag.alias("__xml"), F.struct(order, F.when(flag, as_xml).otherwise(F.to_json(F.struct(*fields))).alias("body")).alias("r"))
    total = rows.count()
    joined = lambda mark: F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["body"]), mark)
    body = F.when(F.first("__xml"), F.concat(F.lit(f"<results><totalCount>{total}</totalCount><data>"), joined(""), F.lit("</data></results>")))
    pages = bodies.groupBy(page).agg(body.otherwise(F.concat(F.lit(f'{{"total_count": {total}, "data": ['), joined(","), F.lit("]}"))).alias("value"))
    pages.select(F.col(page).alias("page"), "value").write.mode("overwrite").partitionBy("page").text(path)
