"""A Spark data source over a paging web service, with retries.

``transport`` names a function ``module:name`` that takes a query string and returns JSON text; it raises
:class:`Busy` when the service asks to wait. Each query is a partition, so executors fetch side by side.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Busy(Exception):
    """The service asks to come again later."""


def with_retries(call, query: str, attempts: int = 3, wait: float = 12.0, sleep=time.sleep) -> str:
    """The answer to ``query``; waits ``wait`` times the number of the attempt after each :class:`Busy`, other errors pass at once."""
    for attempt in range(1, attempts + 1):
        try:
            return call(query)
        except Busy:
            if attempt == attempts:
                raise
            sleep(wait * attempt)
    raise AssertionError("unreachable")


class Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Query]:
        return [Query(q) for q in self.options.get("queries", "").split("\n") if q]

    def read(self, partition: Query) -> Iterator[tuple[str, str]]:
        module, _, name = self.options["transport"].partition(":")
        call = getattr(importlib.import_module(module), name)
        yield partition.text, with_retries(call, partition.text, int(self.options.get("attempts", 3)), float(self.options.get("wait", 12)))


class PaperService(DataSource):
    """``spark.dataSource.register(PaperService)``, then ``spark.read.format("paper_service").option("queries", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "paper_service"

    def schema(self) -> str:
        return "query string, payload string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
