"""Listing pages that were fetched before, as a Spark data source for batches and streams.

Pages lie below a folder as ``feed=<name>/page=<number>/<any file>``, one item as JSON per line; numbers go up in
the order pages were fetched. A page's files are listed once, dealt into partitions of about PART_BYTES, and read by
tasks. Conditions on ``feed`` and ``page`` leave out files before any is opened. As a stream, the offset is the number
of the last page taken: a restarted query goes on behind it. Folders are anything Arrow has a file system for.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition

PART_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 2_000
COLUMNS = "feed string, page long, item string"
PLACE = re.compile(r"(?:^|/)feed=([^/]+)/page=(\d+)/[^/_.][^/]*$")

# Conditions that leave out whole pages, by Spark's names for them.
COMPARE = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt,
           "LessThanOrEqual": operator.le, "In": lambda value, some: value in some}


@dataclass
class Page:
    feed: str
    number: int
    path: str
    size: int


@dataclass
class Pages(InputPartition):
    pages: list


def listed(folder: str) -> list[Page]:
    system, path = fs.FileSystem.from_uri(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        match = PLACE.search(info.path) if info.type == fs.FileType.File else None
        if match:
            found.append(Page(unquote(match[1]), int(match[2]), info.path, info.size))
    return sorted(found, key=lambda p: (p.number, p.feed, p.path))


def dealt(pages: Iterable[Page]) -> list[Pages]:
    parts, size = [], PART_BYTES
    for page in pages:
        if size >= PART_BYTES:
            parts.append(Pages([]))
            size = 0
        parts[-1].pages.append(page)
        size += page.size
    return parts


def items(folder: str, part: Pages | None) -> Iterator[tuple]:
    system, _ = fs.FileSystem.from_uri(folder)
    for page in part.pages if part else []:
        with system.open_input_stream(page.path) as file:
            for line in file.read().decode().splitlines():
                if line.strip():
                    yield page.feed, page.number, line


def batches(folder: str, part: Pages | None) -> Iterator[pa.RecordBatch]:
    """The items of a partition, some thousands at a time."""
    rows = items(folder, part)
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.string()))],
                                         ["feed", "page", "item"])


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on feed and page, and hands back the others."""
        for f in filters:
            if type(f).__name__ in COMPARE and f.attribute in (("feed",), ("page",)):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, page: Page) -> bool:
        value = {"feed": page.feed, "page": page.number}
        return all(COMPARE[kind](value[name], limit) for name, kind, limit in self.tests)

    def partitions(self) -> list[Pages]:
        return dealt(filter(self._wanted, listed(self.folder)))

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition)


class PageStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max((p.number for p in listed(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return dealt(p for p in listed(self.folder) if start["page"] < p.number <= end["page"])

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return items(self.folder, partition)


class FetchedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FetchedPages)
    return spark


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``feed, page, item`` of all pages, the item as JSON."""
    return registered(spark).read.format("fetched_pages").load(folder)


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    return registered(spark).readStream.format("fetched_pages").load(folder)
