"""Rows that a remote service hands out in pages, as a Spark data source for batches and streams.

``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged")`` or ``readStream``
with the options

- ``fetcher``: "module:function", which every worker can import; ``fetcher(offset, limit)`` returns
  the rows (dictionaries) from an offset on, and ``fetcher(0, 0)`` nothing but must not fail;
- ``counter``: "module:function" that returns the number of rows there are now;
- ``page``: rows of a request; ``partition``: rows of a task; ``retries``: further attempts of a request.

A partition is a range of offsets, so tasks ask for their pages independently, a lost task asks
again, and a stream's position is one number: what was committed before a restart is not read again,
and nothing after it is left out. Rows are given as JSON, to be parsed by a schema of the user's.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Offsets(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def imported(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Pages:
    """What both readers share: ranges of offsets, and the pages of one."""

    def __init__(self, options: dict) -> None:
        self.fetcher, self.counter = options["fetcher"], options["counter"]
        self.page, self.size = int(options.get("page", "100")), int(options.get("partition", "10000"))
        self.retries, self.wait = int(options.get("retries", "3")), float(options.get("wait", "0.5"))

    def count(self) -> int:
        return int(imported(self.counter)())

    def ranges(self, start: int, stop: int) -> list[Offsets]:
        return [Offsets(at, min(stop, at + self.size)) for at in range(start, stop, self.size)]

    def rows(self, part: Offsets) -> Iterator[tuple[int, str]]:
        fetch, at = imported(self.fetcher), part.start
        while at < part.stop:
            found = self._asked(fetch, at, min(self.page, part.stop - at))
            if not found:
                raise OSError(f"no rows from offset {at} of {part.stop}")
            for n, row in enumerate(found):
                yield at + n, json.dumps(row, ensure_ascii=False)
            at += len(found)

    def _asked(self, fetch, offset: int, limit: int) -> list[dict]:
        for attempt in range(self.retries + 1):
            try:
                return fetch(offset, limit)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        return []


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Offsets]:
        return self.ranges(0, self.count())

    def read(self, partition: Offsets) -> Iterator[tuple[int, str]]:
        return self.rows(partition)


class PagedStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.count()}

    def partitions(self, start: dict, end: dict) -> list[Offsets]:
        return self.ranges(start["row"], end["row"])

    def read(self, partition: Offsets) -> Iterator[tuple[int, str]]:
        return self.rows(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "row_number long, json string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)
