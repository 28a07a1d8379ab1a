"""Services that give their records page by page, as a source of tables and streams.

A service says how many pages it has and gives one page's records; a task asks for a range of pages, so calls are made on the executors and as many at a time as there are tasks. A
page that fails, after some tries, is a row with the error. Conditions on the page number reach the source: other pages are never asked for.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

RECORDS = "page int, id string, body string, error string"


class Service(Protocol):
    """What a factory named by the option ``service`` makes of the options, on the driver (pages) and in each task (records)."""

    def pages(self) -> int: ...

    def records(self, page: int) -> Iterable[tuple[str, str]]: ...


class FolderService:
    """Pages as folders ``page=<n>`` of JSON lines (id, body) below the option ``path``, in any file system that Arrow opens."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        path = options["path"]
        local = path.removeprefix("file:") if path.startswith("file:/") else path if "://" not in path else None
        self.files, self.path = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local is not None else fs.FileSystem.from_uri(path)

    def _below(self, folder: str) -> list:
        from pyarrow import fs

        return [f for f in self.files.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(("_", "."))]

    def pages(self) -> int:
        return max((int(f.base_name.removeprefix("page=")) + 1 for f in self._below(self.path) if f.base_name.startswith("page=")), default=0)

    def records(self, page: int) -> Iterator[tuple[str, str]]:
        for file in sorted(self._below(f"{self.path}/page={page}"), key=lambda f: f.path):
            with self.files.open_input_stream(file.path) as stream:
                for line in stream.read().decode("utf-8").splitlines():
                    record = json.loads(line)
                    yield str(record["id"]), record["body"]


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _service(options: dict[str, str]) -> Service:
    module, _, factory = options.get("service", "quire.sources.service:FolderService").partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def _ranges(first: int, last: int, options: dict[str, str]) -> list[InputPartition]:
    step = int(options.get("pagespertask", "20"))
    return [Range(n, min(n + step, last)) for n in range(first, last, step)] or [Range(0, 0)]


def _rows(partition: Range, options: dict[str, str]) -> Iterator[tuple]:
    service, tries = _service(options), int(options.get("tries", "3"))
    for page in range(partition.first, partition.last):
        rows, error = [], None
        for _ in range(tries):
            try:
                rows, error = [(page, key, body, None) for key, body in service.records(page)], None
                break
            except Exception as why:  # a page's fault is a row
                error = f"{type(why).__name__}: {why}"
        yield from [(page, None, None, error)] if error else rows


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.first, self.last = dict(options), 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the page are taken over; all other conditions stay Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                high = f.value + (not isinstance(f, LessThan)) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                self.first = max(self.first, low)
                self.last = high if self.last is None else self.last if high is None else min(self.last, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        pages = _service(self.options).pages()
        return _ranges(self.first, pages if self.last is None else min(pages, self.last), self.options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition, self.options)


class PagedStream(DataSourceStreamReader):
    """New pages as they come: the offset is the number of pages that were given."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": _service(self.options).pages()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(start["page"], end["page"], self.options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition, self.options)

    def commit(self, end: dict) -> None:
        """Nothing to keep: Spark remembers the offset."""


class PagedService(DataSource):
    """``spark.read.format("paged_service")``; options: service (``module:factory``), pagesPerTask, tries, and the service's own."""

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, which also has to hand conditions on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)
