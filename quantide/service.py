"""The service's operations, without a transport: validated parameters in, DataFrames or payloads out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantide import params as P
from quantide.operators import annotations, ingest, metrics, universe
from quantide.sources.readers import projected
from quantide.sources.sinks import canonical, split_payload


class Service:
    """Serves a bar table (with an interval column or of one interval), a universe and an annotation log."""

    def __init__(self, bars: DataFrame, universe_table: DataFrame, log: DataFrame | None = None, today: date | None = None):
        self.bars, self.table, self.log, self.today = bars, universe_table, log, today or date.today()

    def _bars(self, tickers: str, lookback_days: object, interval: str) -> tuple[DataFrame, str]:
        names, days, step = P.valid_tickers(tickers), P.valid_int(lookback_days, 30, 2000, "lookback_days"), P.valid_interval(interval)
        rows = self.bars.where(F.col("interval") == step).drop("interval") if "interval" in self.bars.columns else self.bars
        return ingest.price_history(rows, names, days, self.today), step

    def universe(self, top_n: object = P.TOP_N) -> DataFrame:
        return universe.build(self.table, P.valid_int(top_n, 10, 500, "top_n"))

    def prices(self, tickers: str, lookback_days: object = P.LOOKBACK_DAYS, interval: str = "1d", columns: str | None = None) -> dict:
        rows, _ = self._bars(tickers, lookback_days, interval)
        fields = [c for c in rows.columns if c not in ("ticker", "ts")]
        wanted = P.valid_columns(columns)
        if wanted is not None:
            fields = projected(rows.select(*fields), wanted).columns
        return split_payload(rows, fields)

    def metrics(self, tickers: str, metric: str = "cc_vol", lookback_days: object = P.LOOKBACK_DAYS, interval: str = "1d", min_days: object = 10) -> DataFrame:
        """Neither sanitised nor sorted: one row per instrument that the metric gives one for."""
        name = P.valid_metric(metric)
        if name not in metrics.METRICS:
            raise P.ValidationError("unknown metric", metric=name)
        days = P.valid_int(lookback_days, 30, 2000, "lookback_days")
        least = P.valid_int(min_days, 10, days, "min_days")
        rows, step = self._bars(tickers, lookback_days, interval)
        return metrics.compute(name, rows, P.MetricParams(interval=step, min_periods=least))

    def tagged(self, payload: object, known_tag: str | None = None) -> tuple[int, str, str]:
        """(status, body, tag): 304 and no body if the client knows the tag."""
        body, tag = canonical(payload)
        return (304, "", tag) if tag == known_tag else (200, body, tag)

    def annotations(self) -> DataFrame:
        return annotations.latest(self.log)

    def annotation_history(self, ticker: str, limit: int | None = None) -> DataFrame:
        return annotations.history(self.log, P.valid_ticker(ticker), limit)

    def annotate(self, ticker: str, note: str, client_timestamp: object) -> DataFrame:
        """The log with one more entry."""
        row = self.log.sparkSession.createDataFrame([(P.valid_ticker(ticker), annotations.valid_note(note), client_timestamp)], "ticker string, note string, client_timestamp timestamp")
        self.log = annotations.upserted(self.log, row)
        return self.log
