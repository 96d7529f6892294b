"""Volatility and risk metrics, one row per instrument, and their registry."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantide.operators import returns as R
from quantide.params import TRADING_DAYS_PER_YEAR, MetricParams, ValidationError
from quantide.schema import coerced

Metric = Callable[[DataFrame, MetricParams], DataFrame]

#: scales the median absolute deviation to a normal distribution's standard deviation
MAD_SCALE = 1.4826
#: weight of the open-to-close variance in the Yang-Zhang estimate
YANG_ZHANG_K = 0.34
OHLC = ("parkinson_vol", "gk_vol", "rs_vol", "yz_vol", "ewma_vol", "mad_vol")


def annualized_volatility(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """Deviation of grid log returns, annualised by the interval; ``min_periods`` counts returns."""
    out = R.grid_returns(bars).groupBy("ticker").agg(F.count("lr").alias("n"), (F.stddev_samp("lr") * F.sqrt(F.lit(params.annual))).alias("cc_vol"))
    if params.min_periods is not None:
        out = out.where(F.col("n") >= params.min_periods)
    return out.select("ticker", "cc_vol")


def max_drawdown(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    return R.drawdowns(bars).groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown"))


def return_risks(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """sharpe_ratio, var and sortino over the dates on which all instruments have a return; one pass."""
    rows = R.grid_returns(bars)
    e = F.col("r") - params.risk_free / TRADING_DAYS_PER_YEAR
    year = F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))
    stats = R.complete_case(rows).groupBy("ticker").agg(
        (F.try_divide(F.avg(e), F.stddev_samp("r")) * year).alias("sharpe_ratio"),
        F.percentile("r", params.confidence).alias("var"),
        (F.try_divide(F.avg(e), F.stddev_samp(F.when(e < 0, e))) * year).alias("sortino"),
    )
    # instruments stay in the result even if no date is complete
    return rows.select("ticker").distinct().join(stats, "ticker", "left")


def _one(name: str, family: Metric) -> Metric:
    return lambda bars, params: family(bars, params).select("ticker", name)


def ohlc_volatility(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """The six range and return based measures from one window stage and one aggregate.

    A row counts if all price fields that the frame has are finite; the close is the adjusted one where there is such a
    column. Measures whose fields are missing, or whose variance is not a number of 0 or more, are null.
    """
    least = params.min_periods or 0
    have = [f for f in ("open", "high", "low") if f in bars.columns]
    close = "adj_close" if "adj_close" in bars.columns else "close"
    rows = bars.select("ticker", "ts", coerced(F.col(close)).alias("c"), *[coerced(F.col(f)).alias(f[0]) for f in have]).where("c is not null" + "".join(f" and {f[0]} is not null" for f in have))
    if params.tickers is not None:
        rows = rows.where(F.col("ticker").isin(*params.tickers))
    q = lambda a, b: F.ln(F.try_divide(F.col(a), F.col(b)))
    w = R.by_time()
    rows = rows.withColumn("pc", F.lag("c").over(w)).withColumn("r", q("c", "pc"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))).withColumn("med", F.median("r").over(Window.partitionBy("ticker")))
    m = F.when(F.lit(least) > 0, F.lit(least)).otherwise(F.lit(1 << 30))
    lam = params.ewma_lambda
    aggs = {
        "n": F.count(F.lit(1)),
        "nr": F.count("r"),
        "vr": F.var_samp("r"),
        "r2": F.sum(F.col("r") * F.col("r")),
        "ew": F.sum(F.when(F.col("rn") <= m, F.pow(F.lit(lam), F.col("rn") - 1) * F.col("r") * F.col("r"))),
        "mad": F.median(F.abs(F.col("r") - F.col("med"))),
    }
    ln2 = F.ln(F.lit(2.0))
    if {"high", "low"} <= set(have):
        aggs["hl"] = F.avg(F.pow(q("h", "l"), 2))
        if "open" in have:
            aggs |= {"co": F.avg(F.pow(q("c", "o"), 2)), "rs": F.avg(q("h", "c") * q("h", "o") + q("l", "c") * q("l", "o")), "vo": F.var_samp(q("o", "pc")), "vc": F.var_samp(q("c", "o"))}
    g = rows.groupBy("ticker").agg(*[v.alias(k) for k, v in aggs.items()]).where(F.col("n") >= least)
    vol = lambda v: F.when((v >= 0) & (v < float("inf")), F.sqrt(v * params.annual))
    null = F.lit(None).cast("double")
    c = F.col
    used = F.least(m, c("nr"))
    seed = F.when(c("nr") == 1, c("r2")).otherwise(c("vr"))
    enough = (c("nr") >= F.greatest(F.lit(least), F.lit(1)))
    out = {
        "parkinson_vol": vol(c("hl") / (4 * ln2)) if "hl" in aggs else null,
        "gk_vol": vol(0.5 * c("hl") - (2 * ln2 - 1) * c("co")) if "co" in aggs else null,
        "rs_vol": vol(c("rs")) if "co" in aggs else null,
        "yz_vol": vol(c("vo") + YANG_ZHANG_K * c("vc") + (1 - YANG_ZHANG_K) * c("rs")) if "co" in aggs else null,
        "ewma_vol": F.when(enough, vol(F.pow(F.lit(lam), used) * seed + (1 - lam) * c("ew"))),
        "mad_vol": F.when(enough, MAD_SCALE * c("mad") * F.sqrt(F.lit(params.annual))),
    }
    return g.select("ticker", *[v.alias(k) for k, v in out.items()])


def cross_checked(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """cc_vol, parkinson_vol, gk_vol, rs_vol and yz_vol by another way than above: rows joined to the ones before them, variances from sums.

    Bars are taken as they come, without a grid; see ``disagreements``.
    """
    logs = {c: F.ln(coerced(F.col(f))) for c, f in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))}
    rows = bars.select("ticker", F.row_number().over(R.by_time()).alias("k"), *[v.alias(c) for c, v in logs.items()])
    before = rows.select("ticker", (F.col("k") + 1).alias("k"), F.col("c").alias("p"))
    x = rows.join(before, ["ticker", "k"], "left").select("ticker", (F.col("c") - F.col("p")).alias("d"), (F.col("o") - F.col("p")).alias("n"), (F.col("c") - F.col("o")).alias("b"), (F.col("h") - F.col("l")).alias("w"), ((F.col("h") - F.col("c")) * (F.col("h") - F.col("o")) + (F.col("l") - F.col("c")) * (F.col("l") - F.col("o"))).alias("s"))
    sums = [f(F.col(c)).alias(f"{c}{k}") for c in "dnb" for k, f in ((0, F.count), (1, F.sum), (2, lambda v: F.sum(v * v)))]
    g = x.groupBy("ticker").agg(*sums, F.avg(F.col("w") * F.col("w")).alias("w2"), F.avg("s").alias("s1"))
    var = lambda c: F.try_divide(F.col(f"{c}2") - F.try_divide(F.col(f"{c}1") * F.col(f"{c}1"), F.col(f"{c}0")), F.col(f"{c}0") - 1)
    ln2 = F.ln(F.lit(2.0))
    out = {
        "cc_vol": var("d"),
        "parkinson_vol": F.col("w2") / (4 * ln2),
        "gk_vol": F.col("w2") / 2 - (2 * ln2 - 1) * F.try_divide(F.col("b2"), F.col("b0")),
        "rs_vol": F.col("s1"),
        "yz_vol": var("n") + YANG_ZHANG_K * var("b") + (1 - YANG_ZHANG_K) * F.col("s1"),
    }
    return g.select("ticker", *[F.when(v >= 0, F.sqrt(v * params.annual)).alias(k) for k, v in out.items()])


def disagreements(bars: DataFrame, params: MetricParams = MetricParams(), tolerance: float = 1e-6) -> DataFrame:
    """ticker, metric, value and check where a measure and its cross-check differ by more than the tolerance, or only one is there."""
    names = ["cc_vol", "parkinson_vol", "gk_vol", "rs_vol", "yz_vol"]
    long = lambda df, v: df.select("ticker", *names).unpivot("ticker", names, "metric", v)
    j = long(ohlc_volatility(bars, params).join(annualized_volatility(bars, params), "ticker"), "value").join(long(cross_checked(bars, params), "check"), ["ticker", "metric"])
    return j.where(~F.coalesce(F.abs(F.col("value") - F.col("check")) <= tolerance, F.col("value").isNull() & F.col("check").isNull()))


def all_metrics(bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """Every built-in metric as a column; families are computed once each and joined by instrument."""
    out = annualized_volatility(bars, params)
    out = bars.select("ticker").distinct().join(out, "ticker", "left")
    for family in (ohlc_volatility, return_risks, max_drawdown):
        out = out.join(family(bars, params), "ticker", "left")
    return out


# The metrics' keys and display names.
DISPLAY_NAMES = {
    "cc_vol": "Close-to-Close Volatility",
    "parkinson_vol": "Parkinson Volatility",
    "gk_vol": "Garman-Klass Volatility",
    "rs_vol": "Rogers-Satchell Volatility",
    "yz_vol": "Yang-Zhang Volatility",
    "ewma_vol": "EWMA Volatility",
    "mad_vol": "Median Absolute Deviation Volatility",
    "sharpe_ratio": "Sharpe Ratio",
    "max_drawdown": "Maximum Drawdown",
    "var": "Value at Risk",
    "sortino": "Sortino Ratio",
}

METRICS: dict[str, Metric] = {
    "cc_vol": annualized_volatility,
    **{k: _one(k, ohlc_volatility) for k in OHLC},
    **{k: _one(k, return_risks) for k in ("sharpe_ratio", "var", "sortino")},
    "max_drawdown": max_drawdown,
}


def register_metric(name: str, metric: Metric) -> None:
    """Add a metric; a later one of the same name takes its place."""
    METRICS[name] = metric


def metric_choices() -> list[str]:
    return sorted(METRICS)


def display_name(key: str) -> str:
    k = key.strip()
    return DISPLAY_NAMES.get(k, k.replace("_", " ").title()) if k else key


def compute(name: str, bars: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """Run a registered metric; plugins may take only the bars."""
    if name not in METRICS:
        raise ValidationError(f"unknown metric {name!r}", choices=metric_choices())
    metric = METRICS[name]
    takes = [p for p in inspect.signature(metric).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD, p.VAR_POSITIONAL)]
    return metric(bars, params) if len(takes) > 1 or any(p.kind == p.VAR_POSITIONAL for p in takes) else metric(bars)


def discover_plugins(folder: str | None = None, group: str = "quantide.metrics") -> list[str]:
    """Register metrics of installed entry points, and of the files of a folder that the caller trusts; broken ones are skipped."""
    added: list[str] = []
    for point in entry_points(group=group):
        try:
            register_metric(point.name, point.load())
            added.append(point.name)
        except Exception:  # noqa: BLE001, S112
            continue
    for file in sorted(Path(folder).glob("[!_]*.py")) if folder else ():
        spec = importlib.util.spec_from_file_location(f"quantide_plugin_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
            found = dict(getattr(module, "METRICS", {}))
        except Exception:  # noqa: BLE001, S112
            continue
        for name, metric in found.items():
            register_metric(name, metric)
            added.append(name)
    return added


