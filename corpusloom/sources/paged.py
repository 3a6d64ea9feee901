"""A paged record source as a Python data source: one input partition a page, with the providers' stop rules.

Offline it reads the pages of a fixture (option ``pages``: JSON lines of a page each);
with option ``endpoint`` a client class named by ``client`` fetches pages instead.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, title string, abstract string, year int, source string, page int"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def page_count(per_page: int, max_total: int, max_pages: int) -> int:
    """Pages that can be asked for: enough for max_total, max_pages at most."""
    per_page = min(200, max(1, per_page))
    return min(max(1, max_pages), max(1, -(-max_total // per_page)))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.per_page = min(200, max(1, int(options.get("per_page", 25))))

    def partitions(self) -> list[Page]:
        count = page_count(self.per_page, int(options_total(self.options)), int(self.options.get("max_pages", 8)))
        return [Page(i) for i in range(1, count + 1)]

    def fetch(self, number: int) -> list[dict]:
        if "client" in self.options:
            module, _, name = self.options["client"].rpartition(".")
            return getattr(importlib.import_module(module), name)().page(self.options.get("query", ""), number, self.per_page)
        rows = [json.loads(line) for line in self.options.get("pages", "").splitlines() if line.strip()]
        return rows[(number - 1) * self.per_page : number * self.per_page]

    def read(self, partition: Page) -> Iterator[tuple]:
        for r in self.fetch(partition.number):
            if (r.get("title") or "").strip():
                yield (r.get("id"), r["title"].strip(), r.get("abstract") or "", r.get("year"), self.options.get("source", "offline"), partition.number)


def options_total(options: dict) -> str:
    return options.get("max_total", "100")


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
