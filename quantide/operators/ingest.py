"""The incremental bar store: planning, merging, manifests, trims."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantide.functions.text import backfill_start
from quantide.operators.sanitize import latest_rows
from quantide.params import MANIFEST_VERSION, lookback_cutoff


def merge_incremental(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("ticker", "ts")) -> DataFrame:
    """Both together; of rows with the same keys the new one is kept whole."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_rows(both, list(keys), [F.desc("_new")]).drop("_new")


def manifest(bars: DataFrame, interval: str, source: str, version: int = MANIFEST_VERSION, at: Column | None = None) -> DataFrame:
    g = bars.groupBy("ticker").agg(F.min(F.to_date("ts")).alias("start"), F.max(F.to_date("ts")).alias("end"), F.count(F.lit(1)).alias("rows"))
    return g.select("ticker", F.lit(interval).alias("interval"), "start", "end", "rows", F.lit(source).alias("source"), F.lit(version).alias("version"), (at if at is not None else F.current_timestamp()).alias("updated_at"))


def current(manifests: DataFrame) -> DataFrame:
    """Outdated manifests count as not stored."""
    return manifests.where(F.col("version") >= MANIFEST_VERSION)


def fetch_plan(requested: DataFrame, bars: DataFrame, interval: Column, today: Column, force: bool = False) -> DataFrame:
    """ticker, cached_max_ts, fetch_start and needs_fetch.

    Without a stored bar: a full backfill. Intraday: the last stored day again. Else the day after it. A start after today: no fetch.
    """
    last = bars.groupBy("ticker").agg(F.max("ts").alias("cached_max_ts"))
    j = requested.select("ticker").distinct().join(last, "ticker", "left")
    day = F.to_date("cached_max_ts")
    intraday = F.lower(interval).rlike("[mh]$")
    start = F.when(day.isNull() | F.lit(force), backfill_start(interval, today)).when(intraday, day).otherwise(F.date_add(day, 1))
    return j.select("ticker", "cached_max_ts", start.alias("fetch_start"), F.coalesce(start <= today, F.lit(False)).alias("needs_fetch"))


def apply_fetch(plan: DataFrame, source: DataFrame, stored: DataFrame) -> DataFrame:
    """The store after the planned fetches: source rows from each start on, merged over what is stored."""
    wanted = plan.where("needs_fetch").select("ticker", "fetch_start")
    new = source.join(wanted, "ticker").where(F.to_date("ts") >= F.col("fetch_start")).drop("fetch_start")
    return merge_incremental(stored, new)


def replace_suspects(stored: DataFrame, fresh: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspect instruments' bars replaced by fresh ones, if there are any; never merged."""
    again = fresh.join(suspects.select("ticker"), "ticker", "left_semi")
    got = again.select("ticker").distinct()
    return stored.join(got, "ticker", "left_anti").unionByName(again, allowMissingColumns=True)


def with_fallback(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local bars, and remote ones of instruments that have no local bar."""
    return local.unionByName(remote.join(local.select("ticker").distinct(), "ticker", "left_anti"), allowMissingColumns=True)


def trimmed(bars: DataFrame, cutoff: date | Column, fields: list[str] | None = None) -> DataFrame:
    """Bars from the cutoff on, without those that hold no value at all."""
    at = F.lit(cutoff) if isinstance(cutoff, date) else cutoff
    return bars.where(F.col("ts") >= at).na.drop("all", subset=fields or [c for c, t in bars.dtypes if t in ("double", "bigint")])


def price_history(bars: DataFrame, tickers: list[str] | None, lookback_days: int, as_of: date) -> DataFrame:
    """The trimmed history of some instruments; both filters reach the scan."""
    rows = bars.where(F.col("ticker").isin(*tickers)) if tickers is not None else bars
    return trimmed(rows, lookback_cutoff(lookback_days, as_of))


def drop_null_prices(bars: DataFrame, strict: bool = True) -> DataFrame:
    """Without rows holding any null (strict), or lacking the preferred price."""
    if strict:
        return bars.na.drop("any")
    preferred = next((c for c in ("adj_close", "close") if c in bars.columns), None)
    return bars.na.drop(subset=[preferred]) if preferred else bars.na.drop("any")


def missing_report(requested: DataFrame, manifests: DataFrame, intervals: list[str], at: Column | None = None) -> DataFrame:
    """timestamp, interval, ticker and reason of requested instruments without a current entry, per interval."""
    wanted = requested.select("ticker").distinct().withColumn("interval", F.explode(F.array(*[F.lit(i) for i in intervals])))
    gone = wanted.join(current(manifests).select("ticker", "interval"), ["ticker", "interval"], "left_anti")
    return gone.select((at if at is not None else F.current_timestamp()).alias("timestamp"), "interval", "ticker", F.lit("missing_cache").alias("reason"))


def download_outcome(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker and ok: whether any bar with a value arrived."""
    got = bars.na.drop("all", subset=[c for c, t in bars.dtypes if t == "double"]).select("ticker").distinct().withColumn("ok", F.lit(True))
    return requested.select("ticker").distinct().join(got, "ticker", "left").select("ticker", F.coalesce("ok", F.lit(False)).alias("ok"))


def refreshed_intervals(bars: DataFrame, lookback: dict[str, int], as_of: date) -> DataFrame:
    """Bars with an interval column, each interval within its own lookback in days."""
    days = F.create_map(*[F.lit(x) for k, v in lookback.items() for x in (k, v)])
    return bars.where(F.to_date("ts") >= F.date_sub(F.lit(as_of), F.try_element_at(days, F.col("interval"))))


def error_counts(errors: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """n of errors by code (and whatever else is asked for)."""
    return errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
