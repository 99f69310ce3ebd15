"""A paged candidate feed as a Python data source, batch and streaming: one partition per platform, cursors as offsets.

Network adapters plug in by subclassing Pages; the one here makes up its pages from the platform's name, so it runs offline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "platform string, native_id string, uid string, title string, duration double, page int"


class Pages:
    """What an adapter implements: the candidates of a page."""

    size = 5

    def page(self, platform: str, number: int) -> Iterator[tuple]:
        for i in range(self.size):
            h = hashlib.sha256(f"{platform}:{number}:{i}".encode()).hexdigest()
            yield platform, h[:10], f"{platform}__{h[:10]}", f"title {h[10:14]}", float(int(h[14:18], 16) % 600), number


#: Adapters by name. A platform that no adapter serves gives no rows, so a mistyped name stops nothing.
ADAPTERS: dict[str, type[Pages]] = {}


def adapter(*names: str):
    """Registers an adapter for platforms."""

    def add(cls: type[Pages]) -> type[Pages]:
        ADAPTERS.update(dict.fromkeys(names, cls))
        return cls

    return add


adapter("alpha", "beta", "a", "b")(Pages)


def read_pages(platform: str, first: int, last: int) -> Iterator[tuple]:
    if platform in ADAPTERS:
        for n in range(first, last):
            yield from ADAPTERS[platform]().page(platform, n)


class _Part(InputPartition):
    def __init__(self, platform: str, first: int, last: int):
        self.platform, self.first, self.last = platform, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.platforms, self.pages = options.get("platforms", "alpha").split(","), int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(p, 0, self.pages) for p in self.platforms]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_pages(partition.platform, partition.first, partition.last)


class _Stream(DataSourceStreamReader):
    """The offset holds the next page of each platform; each platform is a task of its own, and a replayed batch reads the same pages again."""

    def __init__(self, options: dict):
        self.platforms, self.pages = options.get("platforms", "alpha").split(","), int(options.get("pages", "1"))
        self.at = dict.fromkeys(self.platforms, 0)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.platforms, 0)

    def latestOffset(self) -> dict:
        self.at = {p: min(n + 1, self.pages) for p, n in self.at.items()}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {p: max(self.at[p], end.get(p, 0)) for p in self.platforms}  # after a restart, from where the log ends
        return [_Part(p, start.get(p, 0), end[p]) for p in end if end[p] > start.get(p, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_pages(partition.platform, partition.first, partition.last)

    def commit(self, end: dict) -> None:
        pass


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenforge_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feed)
