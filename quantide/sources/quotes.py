"""Fetching as a partitioned read: a Spark data source with a partition for each batch of instruments, or for a run of batches beyond ``TASKS``.

The names are dealt into batches when the scan is planned; each task asks the source for its batches, with retries, and once more one by
one if a batch fails, so a failure stays with its instrument and comes out as a row with a reason. Any number of instruments is one scan.
Its result is written once, since a scan asks the source again each time it runs; a task that is lost asks again for its batches only.
Names are sent with the partition that asks for them, so what a task is sent doesn't grow with the number of instruments.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantide.functions.shared import written
from quantide.params import unique_in_order
from quantide.schema import BARS
from quantide.sources.fetching import BATCH, Fetched

#: a bar: ticker, stamp, open, high, low, close, adjusted close, volume
Quote = tuple[str, datetime, float | None, float | None, float | None, float | None, float | None, int | None]
#: partitions of a scan at most
TASKS = 1_000
_SCHEMA = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BARS) + ", reason string"


class QuoteSource(Protocol):
    """What a task asks for bars; it is sent to the tasks, so it must be picklable. The end is exclusive."""

    def quotes(self, tickers: list[str], start: date, end: date, interval: str) -> Iterable[Quote]: ...


@dataclass(frozen=True)
class Asking:
    """How a source is asked."""

    source: QuoteSource
    start: date
    end: date
    interval: str
    attempts: int = 5
    wait: float = 0.5
    passing: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)

    def once(self, tickers: list[str]) -> list[Quote]:
        """The batch's bars; passing errors are tried again, waiting twice as long each time."""
        for attempt in range(1, self.attempts + 1):
            try:
                return [tuple(q) for q in self.source.quotes(tickers, self.start, self.end, self.interval)]
            except self.passing:
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * 2 ** (attempt - 1))
        return []

    def rows(self, tickers: list[str]) -> Iterator[tuple]:
        try:
            found = self.once(tickers)
        except Exception as error:  # noqa: BLE001
            if len(tickers) > 1:
                for t in tickers:
                    yield from self.rows([t])
            else:
                yield (tickers[0], *[None] * (len(BARS) - 1), f"{type(error).__name__}: {error}")
            return
        got = set()
        for quote in found:
            got.add(quote[0])
            yield (*quote, None)
        for t in tickers:
            if t not in got:
                yield (t, *[None] * (len(BARS) - 1), "no data")


class _Batches(InputPartition):
    """What a task asks for, one batch after the other."""

    def __init__(self, batches: list[list[str]]):
        super().__init__(0)
        self.batches = batches


class _Reader(DataSourceReader):
    def __init__(self, asking: Asking, batches: list[list[str]]):
        self.asking, self.batches = asking, batches

    def __getstate__(self) -> dict:
        # every task is sent a copy of the reader: the names stay where the scan is planned
        return {"asking": self.asking, "batches": []}

    def partitions(self) -> list[InputPartition]:
        each = max(1, -(-len(self.batches) // TASKS))
        return [_Batches(self.batches[a : a + each]) for a in range(0, len(self.batches), each)] or [_Batches([])]

    def read(self, partition: _Batches) -> Iterator[tuple]:
        for batch in partition.batches:
            yield from self.asking.rows(batch)


def _data_source(asking: Asking, batches: list[list[str]], name: str) -> type[DataSource]:
    class Quotes(DataSource):
        planned = batches

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _SCHEMA

        def reader(self, schema) -> DataSourceReader:
            # tasks are sent this class too, so the process that plans the scan takes the names out of it
            planned, type(self).planned = type(self).planned, []
            return _Reader(asking, planned)

    return Quotes


def quote_scan(spark: SparkSession, asking: Asking, tickers: Iterable[str], batch: int = BATCH, name: str = "quotes") -> DataFrame:
    """BARS and reason, unread: each run of the scan asks the source."""
    names = unique_in_order(tickers)
    spark.dataSource.register(_data_source(asking, [names[a : a + batch] for a in range(0, len(names), batch)], name))
    return spark.read.format(name).load()


def fetch_quotes(spark: SparkSession, asking: Asking, tickers: Iterable[str], batch: int = BATCH) -> Fetched:
    """Bars and failures of many instruments; every instrument is asked for once, but for retries."""
    rows = written(quote_scan(spark, asking, tickers, batch), "quotes")
    failed = rows.where("reason is not null").select("ticker", "reason")
    return Fetched(rows.where("reason is null").drop("reason"), [tuple(r) for r in failed.orderBy("ticker").collect()])
