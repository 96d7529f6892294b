"""Readers: the bar store, legacy CSV files, universe lists, ticker lists, and JSON payloads."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.operators.ingest import current
from quantide.operators.sanitize import latest_rows
from quantide.params import CacheError, DataSourceError, is_intraday
from quantide.schema import BARS, MANIFEST, coerced, finite, normalise_bars


class PriceSource(Protocol):
    """Anything that delivers bars of some instruments between two dates."""

    def get_prices(self, tickers: list[str], start: date, end: date, interval: str) -> DataFrame: ...


class BarStore:
    """Bars as Parquet, partitioned by interval and ticker, with a manifest table beside them.

    Filters on interval and ticker prune partitions; those on ts reach the scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def manifests(self) -> DataFrame:
        """The last entry of each instrument and interval."""
        rows = self._read("manifest", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MANIFEST))
        return latest_rows(rows, ["ticker", "interval"], [F.desc("updated_at")])

    def bars(self, interval: str, tickers: list[str] | None = None) -> DataFrame:
        """Stored bars; instruments whose manifest is missing or outdated count as not stored."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BARS if f.name != "ticker") + ", interval string, ticker string"
        rows = self._read("bars", schema).where(F.col("interval") == interval)
        if tickers is not None:
            rows = rows.where(F.col("ticker").isin(*tickers))
        known = current(self.manifests()).where(F.col("interval") == interval).select("ticker")
        return rows.join(known, "ticker", "left_semi").select(*BARS.names)

    def write(self, rows: DataFrame, entries: DataFrame) -> None:
        """Replaces the partitions of the instruments of ``rows`` (with interval) when the job commits, then appends their manifest entries, of which the last counts."""
        # an instrument with a large share of the rows is split by month
        spread = rows.repartition("ticker", F.date_trunc("month", "ts")).sortWithinPartitions("ticker", "ts")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "ticker").parquet(f"{self.root}/bars")
        entries.write.mode("append").parquet(f"{self.root}/manifest")

    def load(self, ticker: str, interval: str = "1d") -> DataFrame:
        """One instrument's bars by time; an error if there are none."""
        rows = self.bars(interval, [ticker])
        if rows.isEmpty():
            raise CacheError("no stored bars", ticker=ticker, interval=interval)
        return rows.orderBy("ts")

    def stored_tickers(self, interval: str) -> DataFrame:
        return self._read("bars", "interval string, ticker string").where(F.col("interval") == interval).select("ticker").distinct()

    def tickers(self, interval: str) -> list[str]:
        """As a list, for a universe that fits on the driver; ``stored_tickers`` has no bound."""
        return [r.ticker for r in self.stored_tickers(interval).orderBy("ticker").collect()]


def legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of one-file-per-ticker CSV files; the stamp is the column Datetime, else Date; the file's name is the ticker."""
    raw = spark.read.option("header", True).csv(path)
    stamps = [F.col(c).try_cast("timestamp") for c in ("Datetime", "Date") if c in raw.columns]
    if not stamps:
        raise DataSourceError("no Date or Datetime column", path=path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1)
    fields = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume"}
    cols = [F.col(c).alias(k) for k, c in fields.items() if c in raw.columns]
    return normalise_bars(raw.select(F.url_decode(name).alias("ticker"), F.coalesce(*stamps).alias("ts"), *cols).where("ts is not null"))


def has_time_parts(bars: DataFrame) -> DataFrame:
    """ticker and has_time: whether any stamp isn't midnight."""
    part = (F.hour("ts") != 0) | (F.minute("ts") != 0) | (F.second("ts") != 0)
    return bars.groupBy("ticker").agg(F.max(part).alias("has_time"))


def discovered_tickers(legacy: DataFrame, stores: list[DataFrame]) -> DataFrame:
    out = legacy.select("ticker")
    for s in stores:
        out = out.union(s.select("ticker"))
    return out.distinct().orderBy("ticker")


def universe_csv(spark: SparkSession, path: str, min_rows: int = 100, max_age_days: int | None = None, modified: datetime | None = None, now: datetime | None = None) -> DataFrame | None:
    """rank, company, ticker of a list with any letter case in its header; None if it is too old or too short."""
    if max_age_days is not None and modified is not None and (now or datetime.now()) - modified > timedelta(days=max_age_days):
        return None
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if not {"rank", "company", "ticker"} <= set(raw.columns):
        return None
    out = raw.select(F.col("rank").try_cast("int").alias("rank"), "company", "ticker").na.drop(subset=["company", "ticker"])
    return out if out.limit(min_rows).count() >= min_rows else None


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file: comments after #, separated by commas or spaces; first mentions, in order (ord)."""
    lines = spark.read.option("wholetext", True).text(path)
    tokens = lines.select(F.posexplode(F.split(F.regexp_replace("value", "#[^\\n]*", ""), "[,\\s]+")).alias("ord", "t"))
    named = tokens.select("ord", F.replace(F.upper(F.trim("t")), F.lit("."), F.lit("-")).alias("ticker")).where("ticker <> ''")
    return latest_rows(named, ["ticker"], [F.asc("ord")]).orderBy("ord")


def request_window(interval: str, start: datetime, end: datetime, now: datetime) -> dict[str, object]:
    """What a quote service is asked for: 1h is 60m, intraday asks for whole days, the end is at most now and after the start."""
    interval = "60m" if interval == "1h" else interval
    end = min(end, now)
    if end <= start:
        end = start + timedelta(seconds=1)
    if is_intraday(interval):
        return {"interval": interval, "range": f"{max(1, (end - start).days + ((end - start).seconds > 0))}d"}
    return {"interval": interval, "start": start, "end": end}


QUOTE = "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"


def quote_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, ts and raw fields of every stamp in quote payloads; arrays may be absent or short."""
    r = F.get(F.from_json(F.col(column), QUOTE)["chart"]["result"], 0)
    q, a = F.get(r["indicators"]["quote"], 0), F.get(r["indicators"]["adjclose"], 0)["adjclose"]
    rows = payloads.select("ticker", q.alias("q"), a.alias("a"), F.posexplode(r["timestamp"]).alias("i", "t"))
    at = lambda c: F.get(c, F.col("i"))
    fields = [at(F.col("q")[f]).alias(f) for f in ("open", "high", "low", "close")]
    return rows.select("ticker", F.timestamp_seconds("t").alias("ts"), *fields, at(F.col("a")).alias("adj_close"), at(F.col("q")["volume"]).alias("volume"))


def repaired_quotes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, dropped): missing fields take the price (adjusted close, else close), volume 0; stamps without a price are dropped."""
    r = rows.withColumns({f: finite(F.col(f)) for f in ("open", "high", "low", "close", "adj_close", "volume")})
    r = r.withColumn("px", F.coalesce("adj_close", "close"))
    bars = r.where("px is not null").select("ticker", "ts", *[F.coalesce(f, "px").alias(f) for f in ("open", "high", "low", "close")], F.col("px").alias("adj_close"), F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0)).cast("bigint").alias("volume"))
    return bars, r.where("px is null").select("ticker", "ts")


def checked_quotes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Repaired bars; an error if a payload has stamps but no price at all."""
    bars, dropped = repaired_quotes(quote_rows(payloads, column))
    empty = dropped.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")
    if not empty.isEmpty():
        raise DataSourceError("payloads without any price", tickers=[r.ticker for r in empty.limit(20).collect()])
    return bars


SPLIT = "struct<columns:array<array<string>>,index:array<string>,data:array<array<double>>>"


def split_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, ts, field and value of split-oriented payloads whose columns are (field, ticker) pairs."""
    p = payloads.select(F.from_json(F.col(column), SPLIT).alias("p"))
    rows = p.select("p.columns", "p.index", F.posexplode("p.data").alias("i", "row"))
    cells = rows.select("columns", F.get("index", F.col("i")).alias("at"), F.posexplode("row").alias("j", "value"))
    name = F.get("columns", F.col("j"))
    return cells.select(F.get(name, 1).alias("ticker"), F.col("at").try_cast("timestamp").alias("ts"), F.get(name, 0).alias("field"), coerced(F.col("value")).alias("value"))


def split_bars(payloads: DataFrame, ticker: str | None = None, column: str = "payload") -> DataFrame:
    """Bars of split-oriented payloads, of one ticker if given."""
    rows = split_rows(payloads, column)
    rows = rows.where(F.col("ticker") == ticker) if ticker is not None else rows
    fields = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    return normalise_bars(rows.groupBy("ticker", "ts").agg(*[F.max(F.when(F.col("field") == k, F.col("value"))).alias(v) for k, v in fields.items()]))


def wide_to_long(wide: DataFrame, ts: str = "ts", separator: str = "|") -> DataFrame:
    """Bars of a wide matrix whose columns are named field|ticker or ticker|field, told apart by known field names."""
    known = {"open": "open", "high": "high", "low": "low", "close": "close", "adj close": "adj_close", "volume": "volume"}
    parts = {c: c.split(separator) for c in wide.columns if c != ts}
    pairs = {c: (a, b) if a.lower() in known else (b, a) for c, (a, b) in parts.items()}
    rows = wide.select(F.col(ts).alias("ts"), *[coerced(F.col(f"`{c}`")).alias(c) for c in pairs]).unpivot("ts", [f"`{c}`" for c in pairs], "name", "value")
    field = F.create_map(*[F.lit(x) for c, (f, _) in pairs.items() for x in (c, known[f.lower()])])
    name = F.create_map(*[F.lit(x) for c, (_, t) in pairs.items() for x in (c, t)])
    rows = rows.select("ts", name[F.col("name")].alias("ticker"), field[F.col("name")].alias("field"), "value")
    have = sorted({known[f.lower()] for f, _ in pairs.values()})
    return rows.groupBy("ticker", "ts").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in have])


def synthetic_bars(spark: SparkSession, n_rows: int, tickers: list[str], seed: int = 42, minutes: bool = False) -> DataFrame:
    """Positive OHLC bars from hashed noise, the same on every run: for benchmarks and tests."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "ticker", "i"), F.lit(1_000_003)) / 1_000_003.0
    rows = spark.range(n_rows).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker"))
    step = F.expr("timestamp_seconds(1577836800 + i * 60)") if minutes else F.expr("timestamp_seconds(1577836800 + i * 86400)")
    base: Column = 100 * F.exp(0.2 * F.sin(F.col("i") / 37.0) + 0.02 * u(0))
    rows = rows.select("ticker", step.alias("ts"), base.alias("close"), (base * (1 + 0.01 * (u(1) - 0.5))).alias("open"), u(2).alias("a"), u(3).alias("b"))
    top, low = F.greatest("open", "close") * (1 + 0.01 * F.col("a")), F.least("open", "close") * (1 - 0.01 * F.col("b"))
    return rows.select("ticker", "ts", "open", top.alias("high"), low.alias("low"), "close", F.col("close").alias("adj_close"), F.floor(1000 * F.col("a")).alias("volume"))


def first_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns first, the others after them as they are."""
    return df.select(*[c for c in names if c in df.columns], *[c for c in df.columns if c not in names])


def projected(df: DataFrame, selectors: list[str]) -> DataFrame:
    """Columns by selectors in any letter case, in the selectors' order; unknown ones are an error that lists the choices."""
    by = {re.sub("[ _]", "", c.lower()): c for c in df.columns}
    unknown = sorted(s for s in selectors if re.sub("[ _]", "", s.lower()) not in by)
    if unknown:
        raise DataSourceError("unknown columns", unknown=unknown, choices=sorted(df.columns))
    return df.select(*[by[re.sub("[ _]", "", s.lower())] for s in selectors])
