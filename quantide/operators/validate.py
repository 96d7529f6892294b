"""Checks of stored bars against their manifest, the calendar and their interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantide.operators.returns import by_time
from quantide.params import interval_minutes, is_daily, is_intraday
from quantide.schema import finite


def business_day_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """ticker and each session between its first and last day without a bar.

    Days are numbered by the sessions up to them, over the distinct days of bars and calendar. Two neighbouring days of an instrument with
    sessions between their numbers are a gap, and only gaps are expanded: nothing is made for each instrument and session.
    """
    observed = bars.select("ticker", F.to_date("ts").alias("day")).distinct()
    calendar = sessions.select(F.col("session").alias("day"), F.lit(1).alias("open")).unionByName(observed.select("day").distinct().withColumn("open", F.lit(0)))
    days = calendar.groupBy("day").agg(F.max("open").alias("open"))
    # a row for each distinct day
    days = days.withColumn("upto", F.sum("open").over(Window.orderBy("day")))
    before = F.lag("upto").over(Window.partitionBy("ticker").orderBy("day"))
    gaps = observed.join(F.broadcast(days), "day").select("ticker", before.alias("a"), (F.col("upto") - F.col("open")).alias("b")).where("a < b")
    missing = gaps.select("ticker", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("upto"))
    return missing.join(F.broadcast(days.where("open = 1").select("upto", F.col("day").alias("session"))), "upto").select("ticker", "session")


def intraday_gaps(bars: DataFrame, sessions: DataFrame, interval: str, allowed: DataFrame | None = None) -> DataFrame:
    """ticker and each missing bar inside trading hours, between bars of one session."""
    step = int(interval_minutes(interval) * 60)
    s = F.broadcast(sessions)
    rows = bars.select("ticker", "ts", F.to_date("ts").alias("session")).join(s, "session").where("ts between open and close")
    gaps = rows.withColumn("prev", F.lag("ts").over(Window.partitionBy("ticker", "session").orderBy("ts")))
    a, b = F.unix_timestamp("prev") + step, F.unix_timestamp("ts") - step
    gaps = gaps.where(F.unix_timestamp("ts") - F.unix_timestamp("prev") > step)
    # a gap of less than two steps counts as one missing bar
    missing = gaps.select("ticker", F.explode(F.sequence(a, F.greatest(a, b), F.lit(step).cast("bigint"))).alias("t"))
    out = missing.select("ticker", F.timestamp_seconds("t").alias("ts")).distinct()
    return out if allowed is None else out.join(allowed.select("ts").distinct(), "ts", "left_anti").select("ticker", "ts")


def spacing_gaps(bars: DataFrame, interval: str) -> DataFrame:
    """ticker and the widest spacing in minutes where it exceeds the interval."""
    most = interval_minutes(interval)
    rows = bars.select("ticker", "ts", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_time()))).alias("d"))
    return rows.groupBy("ticker").agg((F.max("d") / 60).alias("widest")).where(F.col("widest") > most)


def inferred_interval(bars: DataFrame) -> DataFrame:
    """ticker, minutes (the commonest spacing of its bars, the shortest of equals) and share (of its spacings); instruments with one bar are left out."""
    rows = bars.select("ticker", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_time()))).alias("d")).where("d > 0")
    g = rows.groupBy("ticker", "d").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.max(F.struct("n", -F.col("d"))).alias("m"), F.sum("n").alias("of"))
    return g.select("ticker", (-F.col("m")["col2"] / 60).alias("minutes"), (F.col("m.n") / F.col("of")).alias("share"))


def period_gaps(bars: DataFrame, unit: str) -> DataFrame:
    """ticker, expected and rows where a weekly or monthly series lacks or doubles bars between its first and last."""
    step = F.expr("interval 1 week" if unit == "wk" else "interval 1 month")
    g = bars.groupBy("ticker").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"), F.count(F.lit(1)).alias("rows"))
    return g.select("ticker", F.size(F.sequence("a", "b", step)).cast("bigint").alias("expected"), "rows").where("expected <> rows")


def violations(bars: DataFrame, manifest: DataFrame, order: str | None = None) -> DataFrame:
    """ticker and rule for each cheap rule broken: duplicate or unsorted stamps, null fields, wrong dates or row count.

    ``order``: the column of the rows' stored order; without it order isn't checked.
    """
    fields = [c for c, t in bars.dtypes if t == "double"]
    nulls = F.max(F.greatest(*[finite(F.col(c)).isNull().cast("int") for c in fields], F.lit(0))) if fields else F.lit(0)
    rows = bars
    unsorted = F.lit(0)
    if order:
        rows = rows.withColumn("_back", (F.col("ts") < F.lag("ts").over(Window.partitionBy("ticker").orderBy(order))).cast("int"))
        unsorted = F.coalesce(F.max("_back"), F.lit(0))
    g = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("u"), nulls.alias("nulls"), unsorted.alias("unsorted"), F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    j = g.join(manifest.select("ticker", "start", "end", "rows"), "ticker")
    rules = {"duplicate_timestamps": "n <> u", "unsorted": "unsorted = 1", "null_values": "nulls = 1", "date_range": "a <> start or b <> end", "row_count": "n <> rows"}
    return j.select("ticker", F.explode(F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in rules.items()]))).alias("rule"))


def gaps(bars: DataFrame, sessions: DataFrame, interval: str, allowed: DataFrame | None = None) -> DataFrame:
    """ticker and detail of every gap, by the class of the interval."""
    if is_intraday(interval):
        return intraday_gaps(bars, sessions, interval, allowed).select("ticker", F.col("ts").cast("string").alias("detail"))
    if is_daily(interval):
        return business_day_gaps(bars, sessions).select("ticker", F.col("session").cast("string").alias("detail"))
    unit = "mo" if interval.endswith("mo") else "wk"
    return period_gaps(bars, unit).select("ticker", F.concat_ws("/", "rows", "expected").alias("detail"))
