"""Rank stored instruments from the command line: ``python -m quantide.cli --root STORE --universe LIST.csv``."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from quantide import params as P
from quantide.operators import ingest, metrics, sanitize, universe
from quantide.sources.readers import BarStore, universe_csv
from quantide.sources.sinks import save_csv, save_sqlite


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantide", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the bar store")
    p.add_argument("--universe", help="CSV file with rank, company and ticker")
    p.add_argument("--tickers", help="comma-separated tickers instead of the universe's first ones")
    p.add_argument("--metric", default="cc_vol", choices=metrics.metric_choices())
    p.add_argument("--interval", default="1d", type=P.valid_interval)
    p.add_argument("--lookback-days", default=P.LOOKBACK_DAYS, type=int)
    p.add_argument("--top-n", default=P.TOP_N, type=int)
    p.add_argument("--print-top", default=P.PRINT_TOP, type=int)
    p.add_argument("--min-days", default=P.MIN_DAYS, type=int)
    p.add_argument("--as-of", default=date.today().isoformat(), type=date.fromisoformat)
    p.add_argument("--csv")
    p.add_argument("--sqlite")
    return p


def ranked(bars: DataFrame, table: DataFrame, metric: str, interval: str, min_days: int) -> DataFrame:
    """Sanitise, measure, rank: one lazy plan."""
    status = sanitize.sanitise(bars, min_days)
    return universe.rank_by(metric, sanitize.kept_bars(bars, status), table, P.MetricParams(interval=interval, min_periods=min_days))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quantide").getOrCreate()
    table = universe_csv(spark, a.universe, min_rows=1) if a.universe else None
    table = table if table is not None else spark.createDataFrame(universe.FALLBACK, "rank int, company string, ticker string")
    names = P.unique_in_order(P.normalise_ticker(t) for t in a.tickers.split(",")) if a.tickers else [r.ticker for r in universe.build(table, a.top_n).collect()]
    if len(names) < a.print_top:
        raise SystemExit(f"{len(names)} tickers are fewer than the {a.print_top} to print")
    bars = ingest.price_history(BarStore(spark, a.root).bars(a.interval, names), names, a.lookback_days, a.as_of)
    out = ranked(bars, universe.clean(table).drop("ticker").withColumnRenamed("normalized_ticker", "ticker"), a.metric, a.interval, a.min_days)
    out.limit(a.print_top).show(truncate=False)
    if a.csv:
        save_csv(out, a.csv, escape=True, one_file=True)
    if a.sqlite:
        save_sqlite(out, a.sqlite)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
