"""Incremental mail listings as a Python data source: pages of a folder, offsets that move when a batch is done."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "folder string, id string, payload string"


def pages_of(path: str) -> list[str]:
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.endswith(".json"))


def rows_of(page: str) -> Iterator[tuple]:
    """Messages of a page {"folder", "value": [{"id", "@removed"}]}; tombstones are dropped."""
    with open(page, encoding="utf-8") as f:
        body = json.load(f)
    for m in body.get("value") or []:
        if not (m.get("@removed") or m.get("removed")):
            yield body.get("folder") or os.path.basename(os.path.dirname(page)), m.get("id"), json.dumps(m, sort_keys=True)


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Pages(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in pages_of(self.path)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows_of(partition.path)


def place(page: str) -> list:
    """What orders the pages of a folder: numbers in a name count as numbers, so that page 10 follows page 9."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", os.path.basename(page)) if x]


class Delta(DataSourceStreamReader):
    """The offset is the last page of each folder, as a folder's pages come in order but folders don't; pages of a batch are read by tasks of their own.

    Spark stores an offset once the batch before it is committed."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, str] = {}
        for p in pages_of(self.path):
            folder = os.path.relpath(os.path.dirname(p), self.path)
            if folder not in last or place(p) > place(last[folder]):
                last[folder] = os.path.basename(p)
        return last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for p in pages_of(self.path):
            folder = os.path.relpath(os.path.dirname(p), self.path)
            after = folder not in start or place(p) > place(start[folder])
            if folder in end and after and place(p) <= place(end[folder]):
                out.append(Page(p))
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows_of(partition.path)


class Listing(DataSource):
    """spark.dataSource.register(Listing); spark.read.format("mail-listing").load(folder of page files that all executors see)."""

    @classmethod
    def name(cls) -> str:
        return "mail-listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Pages(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Delta(self.options["path"])
