"""Sanitation of close prices: short, empty and duplicate series.

The tail of a series is its part on the last ``n`` dates of the shared grid, filled
forward and then backward inside the tail. It is built as an array of at most 250
numbers per instrument, so equal tails group without comparing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantide.operators import returns as R


def tail_length(min_days: int) -> int:
    return min(250, max(60, min_days))


def suspect_tail(lookback_days: int) -> int:
    return min(60, max(5, lookback_days // 4))


def tails(closes: DataFrame, grid: DataFrame, n: int) -> DataFrame:
    """ticker and tail: the filled prices on the last n grid dates, null without any price there."""
    last = grid.agg(F.max("idx").alias("last"), F.greatest(F.max("idx") - n + 1, F.lit(1)).alias("from"))
    rows = R.on_grid(closes, grid).join(F.broadcast(last), F.col("idx") >= F.col("from"))
    g = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("idx", "px"))).alias("p"), F.max("from").alias("from"), F.max("last").alias("last"))

    # the last price up to each date, else the first one; arrays are at most n long
    def filled(i: Column) -> Column:
        upto = F.filter("p", lambda x: x["idx"] <= i)
        return F.coalesce(F.try_element_at(upto, F.lit(-1))["px"], F.get(F.col("p"), 0)["px"])

    return g.select("ticker", F.transform(F.sequence("from", "last"), filled).alias("tail"))


def fingerprint(tail: Column) -> Column:
    return F.sha1(F.array_join(F.transform(tail, lambda x: x.cast("string")), ",").cast("binary"))


def first_bars(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """Of bars with the same instrument and stamp the first: by the column ``arrival``, without it any one."""
    return latest_rows(bars, ["ticker", "ts"], [F.asc(arrival)]) if arrival else bars.dropDuplicates(["ticker", "ts"])


def sanitise(bars: DataFrame, min_days: int, order: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """ticker and status: kept, short (fewer prices than min_days), empty (none in the tail) or duplicate.

    Repeated stamps of an instrument count once (see ``first_bars``). Of equal tails the first is kept: by ``order`` (ticker, ord) if given, else by name.
    """
    bars = first_bars(bars, arrival)
    closes = R.close_frame(bars)
    counts = bars.select("ticker").distinct().join(closes.groupBy("ticker").agg(F.count("px").alias("n")), "ticker", "left")
    fp = tails(closes, R.date_grid(bars), tail_length(min_days)).select("ticker", fingerprint(F.col("tail")).alias("fp"))
    j = counts.join(fp, "ticker", "left").withColumn("short", F.coalesce(F.col("n"), F.lit(0)) < min_days)
    if order is not None:
        j = j.join(order.select("ticker", "ord"), "ticker", "left")
    key = F.struct("ord", "ticker") if order is not None else F.struct("ticker")
    first = j.where("not short and fp is not null").groupBy("fp").agg(F.min(key)["ticker"].alias("keeper"))
    j = j.join(first, "fp", "left")
    status = F.when(F.col("short"), "short").when(F.col("fp").isNull(), "empty").when(F.col("ticker") == F.col("keeper"), "kept").otherwise("duplicate")
    return j.select("ticker", status.alias("status"))


def kept_bars(bars: DataFrame, status: DataFrame) -> DataFrame:
    return bars.join(status.where("status = 'kept'").select("ticker"), "ticker", "left_semi")


def drop_summary(status: DataFrame) -> DataFrame:
    """status and the number of series with it, but for the kept."""
    return status.where("status <> 'kept'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def suspect_clusters(bars: DataFrame, lookback_days: int, least: int = 3) -> DataFrame:
    """fingerprint, tickers and n of groups of at least ``least`` series with equal recent tails."""
    closes = R.close_frame(bars)
    fp = tails(closes, R.date_grid(bars), suspect_tail(lookback_days)).select("ticker", fingerprint(F.col("tail")).alias("fingerprint"))
    return fp.groupBy("fingerprint").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def recent_history(bars: DataFrame, as_of: Column, days: int = 5, min_closes: int = 3) -> DataFrame:
    """Tickers with enough closes in the last days."""
    recent = R.close_frame(bars).where((F.col("ts") > F.date_sub(as_of, days)) & (F.to_date("ts") <= as_of))
    return recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_closes).select("ticker")


def rolling_tail(bars: DataFrame, n: int) -> DataFrame:
    """The bars on the last n grid dates."""
    grid = R.date_grid(bars)
    cut = grid.agg(F.max("idx").alias("last"))
    dates = grid.join(F.broadcast(cut), F.col("idx") > F.col("last") - n).select("ts")
    return bars.join(dates, "ts", "left_semi").select(bars.columns)


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
