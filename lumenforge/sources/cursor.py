"""Posts that a remote side gives page by page, newest first, under a cursor, as a streaming source.

The cursor is `section:before`: the place in a list of sections (forums) and the time of the oldest post of the last page. A
page that is full leads on to older posts of its section, a shorter one to the next section. What the next cursor is only
shows in what was fetched, so the offset of a batch is read off its last row; a replayed batch is fetched again between two
offsets that are on record.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "section string, id string, created long, title string"


class Remote:
    """What an adapter implements: posts (id, created, title) of a section, newest first, older than `before`, `most` at most."""

    def __init__(self, options: dict):
        self.options = options

    def page(self, section: str, before: int | None, most: int) -> list[tuple[str, int, str]]:
        raise NotImplementedError


def adapter(name: str) -> type[Remote]:
    """An adapter by `module:Class`; readers live in processes of their own, which import it."""
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)


def parsed(cursor: str) -> tuple[int, int | None]:
    place, _, before = cursor.partition(":")
    return int(place or 0), int(before) if before else None


def following(cursor: str, sections: int, page: list[tuple[str, int, str]], most: int) -> str:
    """The cursor after a page; one past the last section if there is nothing more."""
    place, _ = parsed(cursor)
    if page and len(page) >= most:
        return f"{place}:{min(p[1] for p in page)}"
    return f"{min(place + 1, sections)}:"


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.sections = options.get("sections", "").split(",")
        self.most = int(options.get("most", "100"))
        self.pages = int(options.get("pages", "1"))  # of a batch
        self.remote = adapter(options["remote"])(options)

    def initialOffset(self) -> dict:
        return {"cursor": "0:"}

    def _walk(self, cursor: str, pages: int | None, until: str | None) -> tuple[list[tuple], str]:
        rows: list[tuple] = []
        while parsed(cursor)[0] < len(self.sections) and cursor != until and (pages is None or pages > 0):
            place, before = parsed(cursor)
            page = self.remote.page(self.sections[place], before, self.most)
            rows += [(self.sections[place], *p) for p in page]
            cursor = following(cursor, len(self.sections), page, self.most)
            pages = None if pages is None else pages - 1
        return rows, cursor

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = self._walk(start["cursor"], self.pages, None)
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start["cursor"], None, end["cursor"])[0])

    def commit(self, end: dict) -> None:
        pass


class Posts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenforge_posts"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Posts)
