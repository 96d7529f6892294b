"""The ranked universe of instruments, and rankings joined to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.functions.text import TICKER_RULE, normalized_ticker
from quantide.operators.metrics import DISPLAY_NAMES, all_metrics, compute
from quantide.operators.sanitize import latest_rows
from quantide.params import MetricParams, ValidationError

# The universe that is served when none can be read.
FALLBACK = [(1, "Apple", "AAPL"), (2, "Microsoft", "MSFT"), (3, "Alphabet", "GOOGL"), (4, "Amazon", "AMZN"), (5, "NVIDIA", "NVDA")]


def ranked_pairs(pairs: DataFrame, ord_column: str = "ord") -> DataFrame:
    """rank, company and ticker of collected pairs: first ones kept, ranked anew in order.

    Ranks are made by offsets per block of the order, so no window holds all rows.
    """
    first = latest_rows(pairs, ["ticker"], [F.col(ord_column)])
    block = first.withColumn("_b", F.floor(F.col(ord_column) / 100_000))
    sizes = block.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("_b").orderBy(ord_column))
    return block.withColumn("k", k).join(F.broadcast(before), "_b").select((F.col("before") + F.col("k")).cast("int").alias("rank"), "company", "ticker")


def or_fallback(universe: DataFrame, top_n: int) -> DataFrame:
    spark: SparkSession = universe.sparkSession
    out = spark.createDataFrame(FALLBACK, "rank int, company string, ticker string") if universe.isEmpty() else universe.select("rank", "company", "ticker")
    return out.orderBy("rank").limit(top_n)


def clean(raw: DataFrame) -> DataFrame:
    """rank, company, ticker, normalized_ticker: valid symbols, of each the row with the smallest rank."""
    u = raw.withColumn("rank", F.col("rank").try_cast("int")).na.drop(subset=["company", "ticker"]).withColumn("normalized_ticker", normalized_ticker(F.col("ticker")))
    u = u.where(F.col("normalized_ticker").rlike(TICKER_RULE))
    return latest_rows(u.select("rank", "company", "ticker", "normalized_ticker"), ["normalized_ticker"], [F.asc_nulls_last("rank"), F.asc("company"), F.asc("ticker")])


def build(raw: DataFrame, n: int, history: DataFrame | None = None) -> DataFrame:
    """rank, company and ticker (normalised) of the first n valid symbols; ``history`` lists those with enough closes."""
    u = clean(raw)
    if history is not None:
        u = u.join(history.select(F.col("ticker").alias("normalized_ticker")), "normalized_ticker", "left_semi")
    return u.orderBy(F.asc_nulls_last("rank"), "normalized_ticker").limit(n).select("rank", "company", F.col("normalized_ticker").alias("ticker"))


def align(universe: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ranks and companies of wanted (ticker, company, ord); if any is unknown, all are numbered in order instead."""
    known = latest_rows(universe, ["normalized_ticker"], [F.asc_nulls_last("rank")]).select(F.col("normalized_ticker").alias("ticker"), "rank", F.col("company").alias("known"))
    j = wanted.join(known, "ticker", "left")
    if not j.where("known is null").isEmpty():
        return ranked_pairs(wanted, "ord").select("rank", "company", "ticker")
    return j.select("rank", F.col("known").alias("company"), "ticker")


def ticker_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ticker and change (added or removed)."""
    o, n = old.select("ticker").distinct(), new.select("ticker").distinct()
    return n.exceptAll(o).withColumn("change", F.lit("added")).union(o.exceptAll(n).withColumn("change", F.lit("removed")))


def rank_by(name: str, bars: DataFrame, universe: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """rank, company, ticker and the metric, highest first; instruments outside the universe keep null companies."""
    m = compute(name, bars, params).where(F.col(name).isNotNull())
    u = latest_rows(universe, ["ticker"], [F.asc_nulls_last("rank")]).select("ticker", "rank", "company")
    return m.join(u, "ticker", "left").select("rank", "company", "ticker", name).orderBy(F.desc_nulls_last(name), "ticker")


def top_series(ranking: DataFrame, bars: DataFrame, k: int, name: str) -> DataFrame:
    """The bars of the k instruments that rank highest, ties by ticker."""
    top = ranking.where(F.col(name).isNotNull()).orderBy(F.desc(name), "ticker").limit(k).select("ticker")
    return bars.join(F.broadcast(top), "ticker", "left_semi")


def highlighted(ranking: DataFrame, name: str, first: int = 10) -> DataFrame:
    """The ranking with a flag on its first rows, by the metric, ties by ticker."""
    top = ranking.orderBy(F.desc_nulls_last(name), "ticker").limit(first).select("ticker").withColumn("highlight", F.lit(True))
    return ranking.join(F.broadcast(top), "ticker", "left").select(*ranking.columns, F.coalesce("highlight", F.lit(False)).alias("highlight"))


def default_selection(ranking: DataFrame, name: str, k: int = 5) -> DataFrame:
    """The tickers that are chosen where nothing was: the k highest."""
    return ranking.where(F.col(name).isNotNull()).orderBy(F.desc(name), "ticker").limit(k).select("ticker")


def metric_table(name: str, bars: DataFrame, universe: DataFrame, params: MetricParams = MetricParams(), titles: bool = True) -> DataFrame:
    """Universe rows with every built-in metric (and the asked one), highest first, under display names."""
    m = all_metrics(bars, params)
    if name not in m.columns:
        m = m.join(compute(name, bars, params), "ticker", "left")
    if name not in DISPLAY_NAMES and name not in m.columns:
        raise ValidationError(f"unknown metric {name!r}")
    u = latest_rows(universe, ["ticker"], [F.asc_nulls_last("rank")]).select("rank", "company", "ticker")
    rest = [c for c in DISPLAY_NAMES if c != name] + [c for c in m.columns if c not in DISPLAY_NAMES and c not in ("ticker", name)]
    out = u.join(m, "ticker").where(F.col(name).isNotNull()).select("rank", "company", "ticker", name, *rest).orderBy(F.desc_nulls_last(name), "ticker")
    return out.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in out.columns}) if titles else out
