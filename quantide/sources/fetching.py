"""Fetching from price sources: retries, batches, isolated failures, refreshes of the store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.functions.shared import written
from quantide.operators.ingest import apply_fetch, fetch_plan, trimmed
from quantide.params import DataSourceError, EngineError, ValidationError, full_backfill_start, lookback_cutoff, unique_in_order
from quantide.schema import FAILURES
from quantide.sources.readers import BarStore, PriceSource
from quantide.sources.sinks import save_bars

#: instruments asked for at once
BATCH = 40
MODES = ("batch", "async", "cache")


@dataclass
class RetryingSource:
    """A source that is asked again after passing errors, waiting twice as long each time."""

    source: PriceSource
    attempts: int = 5
    wait: float = 0.5
    passing: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)
    sleep: Callable[[float], None] = time.sleep

    def get_prices(self, tickers: list[str], start: date, end: date, interval: str) -> DataFrame:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.source.get_prices(tickers, start, end, interval)
            except self.passing as error:
                if attempt == self.attempts:
                    raise DataSourceError(f"no answer after {attempt} attempts", tickers=tickers, interval=interval) from error
                self.sleep(self.wait * 2 ** (attempt - 1))
        raise ValidationError("at least one attempt is needed", attempts=self.attempts)


@dataclass
class Fetched:
    """Bars that arrived (None: none did), and (ticker, reason) of every instrument that failed or has none."""

    bars: DataFrame | None
    failures: list[tuple[str, str]] = field(default_factory=list)

    def failure_rows(self, spark: SparkSession, interval: str) -> DataFrame:
        rows = spark.createDataFrame(self.failures, "ticker string, reason string")
        return rows.select(F.current_timestamp().alias("timestamp"), F.lit(interval).alias("interval"), "ticker", "reason").select(*FAILURES.names)


def wrapped(error: Exception, **context: object) -> EngineError:
    """The error as one of the engine's own, with its cause."""
    if isinstance(error, EngineError):
        return error
    out = DataSourceError(f"{type(error).__name__}: {error}", **context)
    out.__cause__ = error
    return out


def fetch_many(source: PriceSource, tickers: Iterable[str], start: date, end: date, interval: str, batch: int = BATCH, workers: int = 4) -> Fetched:
    """Bars of many instruments, in batches side by side; a batch that fails is asked for one by one, so a failure stays with its instrument."""
    names = unique_in_order(tickers)

    def ask(some: list[str]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
        try:
            # written once: the source isn't asked again by what reads the bars, and its late errors belong to this batch
            rows = written(source.get_prices(some, start, end, interval), "fetched")
            got = {r.ticker for r in rows.select("ticker").distinct().collect()}
            return [rows], [(t, "no data") for t in some if t not in got]
        except Exception as error:  # noqa: BLE001
            if len(some) == 1:
                return [], [(some[0], str(wrapped(error, ticker=some[0])))]
            parts = [ask([t]) for t in some]
            return [f for frames, _ in parts for f in frames], [x for _, bad in parts for x in bad]

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        parts = list(pool.map(ask, [names[a : a + batch] for a in range(0, len(names), batch)]))
    frames = [f for fs, _ in parts for f in fs]
    return Fetched(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None, [x for _, bad in parts for x in bad])


def refresh(store: BarStore, source: PriceSource, tickers: Iterable[str], interval: str, today: date, force: bool = False, workers: int = 4, origin: str = "api") -> Fetched:
    """Fetch what the plan asks for, merge it over the stored bars and save the instruments touched; failures are listed, the rest is saved."""
    names = unique_in_order(tickers)
    stored = store.bars(interval, names)
    requested = store.spark.createDataFrame([(t,) for t in names], "ticker string")
    plan = fetch_plan(requested, stored, F.lit(interval), F.lit(today), force)
    starts: dict[date, list[str]] = {}
    # one row per requested instrument
    for r in plan.where("needs_fetch").orderBy("ticker").collect():
        starts.setdefault(r.fetch_start, []).append(r.ticker)
    parts = [fetch_many(source, some, start, today + timedelta(days=1), interval, workers=workers) for start, some in starts.items()]
    frames = [p.bars for p in parts if p.bars is not None]
    out = Fetched(None, [x for p in parts for x in p.failures])
    if frames:
        fresh = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        touched = fresh.select("ticker").distinct()
        old = stored if not force else stored.limit(0)
        merged = apply_fetch(plan, fresh, old.join(touched, "ticker", "left_semi"))
        # the store is read and replaced, so the merged rows are fixed first
        out.bars = written(merged, "refreshed")
        if not out.bars.isEmpty():
            save_bars(store, out.bars, interval, origin, validate=False)
    return out


def backfill(store: BarStore, source: PriceSource, tickers: Iterable[str], intervals: Iterable[str], today: date) -> dict[str, Fetched]:
    """A full fetch of every interval; one interval's failures don't stop the others."""
    names = list(tickers)
    return {i: refresh(store, source, names, i, today, force=True) for i in intervals}


def history(store: BarStore, source: PriceSource | None, tickers: Iterable[str], lookback_days: int, interval: str, today: date, mode: str = "batch") -> DataFrame:
    """Trimmed bars: of the store alone (cache), or freshly fetched in one row of batches (batch) or side by side (async)."""
    if mode not in MODES:
        raise ValidationError("unknown mode", mode=mode, choices=list(MODES))
    names, cutoff = unique_in_order(tickers), lookback_cutoff(lookback_days, today)
    if mode == "cache":
        return trimmed(store.bars(interval, names), cutoff)
    start = max(cutoff, full_backfill_start(interval, today))
    found = fetch_many(source, names, start, today + timedelta(days=1), interval, workers=1 if mode == "batch" else 4)
    if found.bars is None:
        raise DataSourceError("no bars from the source", failures=found.failures[:20])
    return trimmed(found.bars, cutoff)
