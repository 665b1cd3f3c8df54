"""Paged interfaces as a Spark source: spark.read.format("paged_json").

The interface is asked on the driver only how many pages there are: by the count that its first page tells, or else by asking for pages at doubling distances
and halving the last gap. Tasks read runs of pages on their own, so a task that is lost reads its pages again and no others.

Options: url, with {offset}, {page} and {limit} where the interface takes them; size (items a page), items (path to the list in an answer, as a/b; empty: the answer is the list), total (path to
the number of items), pages (pages a task), most (pages in all), tries and pause (seconds) for answers with status 429. Columns: place (of the item in the whole), item (its JSON)."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def at(answer: Any, path: str) -> Any:
    """What is at a path of an answer; null where there is nothing."""
    for step in filter(None, path.split("/")):
        answer = answer.get(step) if isinstance(answer, dict) else None
    return answer


class Interface:
    """Pages of a template address."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, usual: options.get(name, usual)
        self.url, self.size = options["url"], int(get("size", "50"))
        self.items, self.total = get("items", ""), get("total", "")
        self.pages, self.tries, self.pause = int(get("pages", "20")), int(get("tries", "20")), float(get("pause", "10"))
        self.most = int(options["most"]) if "most" in options else None

    def ask(self, page: int) -> Any:
        """The answer to a page, null for one without content. Refusals (429) wait for what Retry-After says, else `pause` seconds."""
        address = self.url.format(offset=page * self.size, page=page, limit=self.size)
        for _ in range(self.tries):
            try:
                with urllib.request.urlopen(address) as got:
                    return None if got.status == 204 else json.loads(got.read())
            except urllib.error.HTTPError as e:
                if e.code != 429:
                    raise
                after = str(e.headers.get("Retry-After", ""))
                time.sleep(float(after) if after.isdecimal() else self.pause)
        raise TimeoutError(f"refused {self.tries} times in a row: {address}")

    def page(self, page: int) -> list:
        return at(self.ask(page), self.items) or []

    def count(self) -> int:
        """How many pages there are."""
        if self.total:
            told = at(self.ask(0), self.total)
            if told is not None:
                n = -(-int(told) // self.size)
                return n if self.most is None else min(n, self.most)
        ends = lambda n: self.most is not None and n >= self.most or not self.page(n)
        if ends(0):
            return 0
        low, high = 0, 1  # page `low` has items
        while not ends(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if ends(middle) else (middle, high)
        return high


class Pages(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.interface = Interface(options)

    def partitions(self) -> list[InputPartition]:
        n, run = self.interface.count(), self.interface.pages
        return [Pages(a, min(a + run, n)) for a in range(0, n, run)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for page in range(partition.first, partition.end):
            for i, item in enumerate(self.interface.page(page)):
                yield page * self.interface.size + i, json.dumps(item, ensure_ascii=False)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "place bigint, item string"

    def reader(self, schema: Any) -> DataSourceReader:
        return PagedReader(dict(self.options))


def read_pages(spark: SparkSession, url: str, **options: Any) -> DataFrame:
    """place, item of a paged interface."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(url=url, **{k: str(v) for k, v in options.items()}).load()
