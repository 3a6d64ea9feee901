"""A stream over a provider that gives its records page by page behind cursors.

The offset is the cursor itself, so a query that starts again from its checkpoint asks
for the next page and none twice. To find the end of a batch the driver follows cursors only, each once;
the pages of the batch are dealt in runs to partitions that tasks fetch. While pages are left a batch has twice as many as
the one before, up to a bound, so that a long backlog takes few batches. A client class named by the option ``client``
talks to the provider: ``Client(options).next_cursor(cursor)`` gives the cursor after a page (None after the last) and
``records(cursor)`` its records; both must give the same for the same cursor.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "id long, title string, cursor string, page long"
FIRST = "*"
#: Pages that a batch grows to, and runs of pages that one is dealt in.
MOST_PAGES, MOST_RUNS = 8192, 64


class CursorPages(InputPartition):
    """A run of (cursor, page)."""

    def __init__(self, pages: list[tuple[str, int]]) -> None:
        self.pages = pages


class CursorReader(DataSourceStreamReader):
    """Options: ``client``; ``max_records`` and ``per_page`` bound how many pages are asked for in all, ``batch_pages`` how many in the first batch."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.batch = max(1, int(options.get("batch_pages", 8)))
        per_page = min(200, max(1, int(options.get("per_page", 200))))
        limit = int(options.get("max_records", 0))
        self.most = -(-limit // per_page) if limit else None
        self.at: dict | None = None
        self.walked: list[dict] = []

    def client(self):
        module, _, name = self.options["client"].rpartition(".")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:
        return {"cursor": FIRST, "page": 0}

    def walk(self, start: dict, most: int | None) -> Iterator[dict]:
        """The offsets after each page from ``start`` on; a null cursor ends them."""
        client, at, n = self.client(), start, 0
        while at["cursor"] is not None and (most is None or n < most) and (self.most is None or at["page"] < self.most):
            at = {"cursor": client.next_cursor(at["cursor"]), "page": at["page"] + 1}
            n += 1
            yield at

    def latestOffset(self) -> dict:
        """The offset a batch after the last one given out; the next batch is twice as large. A new reader begins at the first and goes on past what a checkpoint has."""
        last = self.at or self.initialOffset()
        self.walked = [last, *self.walk(last, self.batch)]
        if len(self.walked) > self.batch:
            self.batch = max(self.batch, min(2 * self.batch, MOST_PAGES))
        self.at = self.walked[-1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[CursorPages]:
        n = max(0, end["page"] - start["page"])
        steps = self.walked if n and self.walked and self.walked[0] == start and self.walked[-1] == end else [start, *self.walk(start, n)]
        self.at = max(self.at or steps[-1], steps[-1], key=lambda o: o["page"])
        pages = [(o["cursor"], o["page"]) for o in steps[:-1]]
        size = max(1, -(-len(pages) // MOST_RUNS))
        return [CursorPages(pages[i : i + size]) for i in range(0, len(pages), size)]

    def read(self, partition: CursorPages) -> Iterator[tuple]:
        client = self.client()
        for cursor, page in partition.pages:
            for r in client.records(cursor):
                yield (r["id"], r.get("title"), cursor, page)


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_records"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(self.options)


class FolderClient:
    """Serves pages that a job wrote: option ``location`` is a folder with a folder ``cursor=<name>`` of JSON lines for each page, of any file
    system that Arrow knows; a page's lines hold the name of the next."""

    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(options["location"]) if "://" in options["location"] or options["location"].startswith("file:") else (fs.LocalFileSystem(), options["location"])

    def lines(self, cursor: str) -> list[dict]:
        from pyarrow import fs

        folder = f"{self.folder.rstrip('/')}/cursor={'first' if cursor == FIRST else cursor}"
        out = []
        for info in self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.startswith("part-"):
                with self.fs.open_input_stream(info.path) as file:
                    out += [json.loads(line) for line in file.read().decode().splitlines() if line]
        return out

    def next_cursor(self, cursor: str) -> str | None:
        return next((r.get("next") for r in self.lines(cursor)), None)

    def records(self, cursor: str) -> list[dict]:
        return sorted(self.lines(cursor), key=lambda r: r["id"])
