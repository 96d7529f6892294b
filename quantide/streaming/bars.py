"""Continuous bars and stores, by Structured Streaming."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quantide.functions.shared import shared_folder
from quantide.operators.ingest import manifest, merge_incremental
from quantide.operators.sanitize import latest_rows
from quantide.operators.validate import violations
from quantide.sources.readers import BarStore
from quantide.sources.sinks import save_bars


def state_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's state below ``spark.checkpoint.dir``; a session in local mode without one gets its own."""
    return shared_folder(spark, f"streams/{name}")


def tick_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ticks from Parquet files as they arrive; ts without a zone becomes a timestamp, as watermarks need."""
    ticks = spark.readStream.schema(schema).parquet(path)
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 day", ticker: str = "ticker", value: str = "value", tie: str = "event_id") -> DataFrame:
    """OHLCV bars per window; ticks later than the watermark are left out."""
    at = F.struct("ts", tie)
    g = ticks.withWatermark("ts", late).where(F.col(value) > 0).groupBy(F.window("ts", width).alias("w"), F.col(ticker).cast("string").alias("ticker"))
    out = g.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all that is there into a table kept in memory, and return it. For results of bounded size."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def newest_versions(bars: DataFrame, late: str, arrival: str) -> DataFrame:
    """Each bar once, in its newest version (the highest ``arrival``), as soon as the watermark has passed it.

    For append mode: state holds a version of each bar that the watermark hasn't passed, and a later correction replaces it
    there; rows that come after the watermark are left out.
    """
    rest = [c for c in bars.columns if c not in ("ticker", "ts")]
    newest = bars.withWatermark("ts", late).groupBy("ticker", "ts").agg(F.max_by(F.struct(*rest), arrival).alias("v"))
    return newest.select("ticker", "ts", *[F.col(f"v.{c}") for c in rest])


def to_files(stream: DataFrame, path: str, checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Closed rows as Parquet files. The sink's log lists the files of each committed batch, so a query that is stopped anywhere and started again on its checkpoint adds none twice; nothing is held on the driver."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def supervised(start: Callable[[], StreamingQuery], attempts: int = 5, wait: float = 1.0, most: float = 60.0, stop: threading.Event | None = None, sleep: Callable[[float], object] = time.sleep) -> list[str]:
    """Runs a query to its end or until ``stop`` is set, and starts it again on its checkpoint when it fails, waiting twice as long after each failure in a row.

    Returns the failures survived. A batch that goes through ends the row of failures; after ``attempts`` failures in one row the last is raised.
    """
    failures, row, done = [], 0, -1
    while True:
        query = start()
        try:
            while query.isActive and not (stop and stop.is_set()):
                query.awaitTermination(1)
            if query.isActive:
                query.stop()
            if (error := query.exception()) is None:
                return failures
        except Exception as raised:  # noqa: BLE001
            error = raised
        failures.append(str(error).splitlines()[0])
        last = max((p["batchId"] for p in query.recentProgress), default=-1)
        row, done = (1 if last > done else row + 1), max(last, done)
        if row >= attempts:
            raise error
        if stop and stop.is_set():
            return failures
        sleep(min(most, wait * 2 ** (row - 1)))


def upsert_stream(bars: DataFrame, store: BarStore, interval: str, checkpoint: str, source: str = "stream", period: str | None = None, arrival: str | None = None) -> StreamingQuery:
    """Merge each micro-batch over the store (needs a checkpoint folder for the session): newer rows of a stamp win; inside a batch the one with the highest ``arrival``, if that column is named. ``period`` keeps it running; without it, it ends when caught up."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = latest_rows(batch, ["ticker", "ts"], [F.desc(arrival)]).drop(arrival) if arrival else batch.dropDuplicates(["ticker", "ts"])
        touched = rows.select("ticker").distinct()
        merged = merge_incremental(store.bars(interval).join(touched, "ticker", "left_semi"), rows)
        # the store is read and replaced in one batch, so the merged rows are fixed first
        save_bars(store, merged.checkpoint(), interval, source, validate=False)

    writer = bars.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def isolated_upsert(bars: DataFrame, store: BarStore, interval: str, checkpoint: str, retries: str, source: str = "stream", period: str | None = None) -> StreamingQuery:
    """``upsert_stream`` in which an instrument that breaks a rule doesn't stop the others.

    Instruments of a micro-batch are judged by one aggregate. Those in order are merged and saved together; rows of the others go, with
    the rules broken, to the Parquet table ``retries``, in a folder of the batch, so a batch that is run again replaces what it had put there. ``retried`` takes them up again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.checkpoint()
        bad = violations(rows, manifest(rows, interval, source)).groupBy("ticker").agg(F.array_sort(F.collect_set("rule")).alias("rules")).checkpoint()
        rows.join(bad, "ticker").write.mode("overwrite").parquet(f"{retries}/batch={number}")
        good = rows.join(bad, "ticker", "left_anti")
        if not good.isEmpty():
            touched = good.select("ticker").distinct()
            merged = merge_incremental(store.bars(interval).join(touched, "ticker", "left_semi"), good)
            save_bars(store, merged.checkpoint(), interval, source, validate=False)

    writer = bars.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def retried(store: BarStore, interval: str, retries: str, mended: Callable[[DataFrame], DataFrame], source: str = "retry") -> DataFrame:
    """Merges the mended rows of ``retries`` into the store, of a stamp those of the latest batch; returns ticker and rules of the instruments that still break one."""
    rows = store.spark.read.parquet(retries)
    fixed = latest_rows(mended(rows.drop("rules")), ["ticker", "ts"], [F.desc("batch")]).drop("batch").checkpoint()
    bad = violations(fixed, manifest(fixed, interval, source)).groupBy("ticker").agg(F.array_sort(F.collect_set("rule")).alias("rules")).checkpoint()
    good = fixed.join(bad, "ticker", "left_anti")
    if not good.isEmpty():
        merged = merge_incremental(store.bars(interval).join(good.select("ticker").distinct(), "ticker", "left_semi"), good)
        save_bars(store, merged.checkpoint(), interval, source, validate=False)
    return bad


def deduplicated(ticks: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first arrival within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class RefreshCounters(StreamingQueryListener):
    """Counts of batches, rows and failures of the session's streams."""

    def __init__(self, told: Callable[[str, int], None] | None = None):
        self.counts = {"started": 0, "batches": 0, "rows": 0, "failed": 0}
        self.told = told

    def _add(self, key: str, n: int) -> None:
        self.counts[key] += n
        if self.told:
            self.told(key, n)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add("started", 1)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._add("batches", 1)
        self._add("rows", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add("failed", int(event.exception is not None))


class RefreshDurations(RefreshCounters):
    """Also a histogram of the batches' durations, and the runs by outcome; its size doesn't grow with the batches."""

    LIMITS = (0.1, 0.5, 1.0, 5.0, 10.0, 60.0, 600.0)

    def __init__(self, told: Callable[[str, int], None] | None = None):
        super().__init__(told)
        self.buckets: Counter[float] = Counter()
        self.outcomes: Counter[str] = Counter()
        self.seconds = 0.0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        super().onQueryProgress(event)
        took = event.progress.durationMs.get("triggerExecution", 0) / 1000
        self.seconds += took
        self.buckets[next((x for x in self.LIMITS if took <= x), float("inf"))] += 1

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        super().onQueryTerminated(event)
        self.outcomes["failed" if event.exception is not None else "finished"] += 1

    def table(self, spark: SparkSession) -> DataFrame:
        """kind (batch or run), name (the bucket's upper limit in seconds, or the outcome) and n."""
        rows = [("batch", str(x), self.buckets[x]) for x in (*self.LIMITS, float("inf"))] + [("run", k, n) for k, n in sorted(self.outcomes.items())]
        return spark.createDataFrame(rows, "kind string, name string, n long")
