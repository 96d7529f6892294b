"""Closes, the shared date grid, and returns.

Grid returns pair a date with the grid date before it, where the grid holds the
dates of all instruments: a missing price makes both returns beside it missing. The
grid isn't materialised: each row gets the number of its date on the grid, and a
return counts where the row before it is one number less. Compressed returns take
the row before, whatever its date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantide.params import ROLLING_WINDOWS, TRADING_DAYS_PER_YEAR
from quantide.schema import coerced

def by_time() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("ts")


def close_frame(bars: DataFrame) -> DataFrame:
    """ticker, ts and px: the adjusted close if the frame has that column, else the close; rows without a price go."""
    field = "adj_close" if "adj_close" in bars.columns else "close"
    return bars.select("ticker", "ts", coerced(F.col(field)).alias("px")).where("px is not null")


def date_grid(bars: DataFrame) -> DataFrame:
    """ts and its number from 1 over all instruments' dates.

    Days are numbered by an offset per day (a small table) and inside each day, so no window holds all dates.
    """
    dates = bars.select("ts").distinct().withColumn("day", F.to_date("ts"))
    days = dates.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    days = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    numbered = dates.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("ts")))
    return numbered.join(days, "day").select("ts", (F.col("before") + F.col("k")).alias("idx"))


def on_grid(closes: DataFrame, grid: DataFrame) -> DataFrame:
    return closes.join(grid, "ts").select("ticker", "ts", "idx", "px")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def grid_returns(bars: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """ticker, ts, idx, px, r (simple) and lr (log), null where the grid date before has no price.

    ``bars`` sets the grid; ``closes`` restricts the instruments, by default none.
    """
    rows = on_grid(closes if closes is not None else close_frame(bars), date_grid(bars))
    prev = F.when(F.lag("idx").over(by_time()) == F.col("idx") - 1, F.lag("px").over(by_time()))
    q = ratio(F.col("px"), F.col("prev"))
    return rows.withColumn("prev", prev).withColumn("r", q - 1).withColumn("lr", F.ln(q)).drop("prev")


def daily_returns(bars: DataFrame) -> DataFrame:
    return grid_returns(bars).where("r is not null").select(F.col("ts").alias("date"), "ticker", F.col("r").alias("daily_return"))


def complete_case(returns: DataFrame) -> DataFrame:
    """The returns on dates on which every instrument has one."""
    n = returns.agg(F.count_distinct("ticker").alias("n_tickers"))
    full = returns.where("r is not null").groupBy("ts").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_tickers")).select("ts")
    return returns.join(full, "ts", "left_semi")


def drawdowns(bars: DataFrame) -> DataFrame:
    """date, ticker and drawdown from the highest close so far."""
    top = F.max("px").over(by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return close_frame(bars).select(F.col("ts").alias("date"), "ticker", (ratio(F.col("px"), top) - 1).alias("drawdown"))


def rolling_volatility(bars: DataFrame, windows: tuple[int, ...] = ROLLING_WINDOWS) -> DataFrame:
    """date, ticker, window and annualised deviation over full windows of grid returns; one pass for all windows."""
    rows = grid_returns(bars)
    frame = lambda k: Window.partitionBy("ticker").orderBy("idx").rangeBetween(-(k - 1), 0)
    rolled = rows.select("ticker", "ts", *[F.when(F.count("lr").over(frame(k)) == k, F.stddev_samp("lr").over(frame(k)) * F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))).alias(f"w{k}") for k in windows])
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.col(f"w{k}").alias("rolling_volatility")) for k in windows]))
    return rolled.select(F.col("ts").alias("date"), "ticker", wide.alias("x")).select("date", "ticker", "x.*").where("rolling_volatility is not null")
