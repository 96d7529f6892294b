from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantide.operators import metrics, returns
from quantide.params import MetricParams, ValidationError


def closes(spark, start="2020-01-01", **series):
    day = datetime.fromisoformat(start)
    rows = [(t, day + timedelta(days=i), float(v)) for t, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close double")


@pytest.fixture(scope="module")
def small(spark):
    return closes(spark, A=[100, 110, 105, 120], B=[50, 55, 60, 58]).cache()


@pytest.fixture(scope="module")
def risky(spark):
    return closes(spark, A=[100, 110, 105, 102, 100], B=[100, 90, 95, 94, 96]).cache()


def values(df, column):
    return {r["ticker"]: r[column] for r in df.collect()}


# The literals of these cases are published results for the same prices.
def test_close_to_close(small):
    v = values(metrics.compute("cc_vol", small), "cc_vol")
    assert v["A"] == pytest.approx(1.505921, abs=1e-6) and v["B"] == pytest.approx(1.148106, abs=1e-6)
    assert metrics.compute("cc_vol", small, MetricParams(min_periods=4)).count() == 0


def test_max_drawdown(small):
    v = values(metrics.compute("max_drawdown", small), "max_drawdown")
    assert v["A"] == pytest.approx(-0.045455, abs=1e-6) and v["B"] == pytest.approx(-0.033333, abs=1e-6)


def test_rolling(small):
    got = sorted(r.rolling_volatility for r in returns.rolling_volatility(small, (2,)).collect())
    assert got == pytest.approx(sorted([1.59204, 0.093154, 2.021072, 1.357244]), abs=1e-5)


def test_sharpe(small):
    v = values(metrics.compute("sharpe_ratio", small), "sharpe_ratio")
    assert v["A"] == pytest.approx(10.5827, abs=1e-4) and v["B"] == pytest.approx(11.192938, abs=1e-5)


def test_var_and_sortino(risky):
    v, s = values(metrics.compute("var", risky), "var"), values(metrics.compute("sortino", risky), "sortino")
    assert v["A"] == pytest.approx(-0.042922, abs=1e-6) and v["B"] == pytest.approx(-0.086579, abs=1e-6)
    assert s["A"] == pytest.approx(1.925098, abs=1e-5) and s["B"] == pytest.approx(-2.11356, abs=1e-5)


def test_grid_breaks_both_returns_beside_a_hole(spark):
    bars = closes(spark, A=[100, 110, None, 120, 130], B=[1, 2, 3, 4, 5])
    got = {(r.ticker, r.date.day) for r in returns.daily_returns(bars).collect()}
    assert got == {("A", 2), ("A", 5), ("B", 2), ("B", 3), ("B", 4), ("B", 5)}


def test_complete_case_couples_instruments(spark):
    full = closes(spark, A=[1, 2, 3, 5], B=[4, 5, 5, 6])
    hole = closes(spark, A=[1, 2, 3, 5], B=[4, 5, None, 6])
    assert values(metrics.compute("sharpe_ratio", full), "sharpe_ratio")["A"] != values(metrics.compute("sharpe_ratio", hole), "sharpe_ratio")["A"]
    # volatility of A doesn't depend on B
    assert values(metrics.compute("cc_vol", full), "cc_vol")["A"] == values(metrics.compute("cc_vol", hole), "cc_vol")["A"]


def ohlc_rows(seed, n=40, holes=()):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(n)))
    o = c * np.exp(0.01 * rng.standard_normal(n))
    h, low = np.maximum(o, c) * np.exp(0.01 * rng.random(n)), np.minimum(o, c) * np.exp(-0.01 * rng.random(n))
    rows = [[float(x) for x in r] for r in zip(o, h, low, c)]
    for i, j in holes:
        rows[i][j] = float("nan")
    return rows


def reference_ohlc(rows, m, ppy=252.0, lam=0.94):
    x = np.array([r for r in rows if np.isfinite(r).all()])
    o, h, low, c = x.T
    r = np.diff(np.log(c))
    hl, co = np.mean(np.log(h / low) ** 2), np.mean(np.log(c / o) ** 2)
    rs = np.mean(np.log(h / c) * np.log(h / o) + np.log(low / c) * np.log(low / o))
    yz = np.var(np.log(o[1:] / c[:-1]), ddof=1) + 0.34 * np.var(np.log(c / o), ddof=1) + 0.66 * rs
    ew = np.var(r, ddof=1)
    for v in r[-m:]:
        ew = lam * ew + (1 - lam) * v * v
    med = np.median(np.abs(r - np.median(r)))
    return [np.sqrt(v * ppy) for v in (hl / (4 * np.log(2)), 0.5 * hl - (2 * np.log(2) - 1) * co, rs, yz, ew)] + [1.4826 * med * np.sqrt(ppy)]


def test_ohlc_against_numpy(spark):
    data = {"AAA": ohlc_rows(1, holes=[(2, 2)]), "BBB": ohlc_rows(2, holes=[(5, 0), (7, 3)])}
    day = datetime(2021, 1, 4)
    rows = [(t, day + timedelta(days=i), *map(str, v)) for t, vs in data.items() for i, v in enumerate(vs)]
    bars = spark.createDataFrame(rows, "ticker string, ts timestamp, open string, high string, low string, close string")
    got = {r.ticker: [r[k] for k in metrics.OHLC] for r in metrics.ohlc_volatility(bars, MetricParams(min_periods=10)).collect()}
    for t, vs in data.items():
        assert got[t] == pytest.approx(reference_ohlc(vs, 10), rel=1e-9)


def test_ohlc_degrades_without_fields(spark):
    bars = closes(spark, A=[1, 2, 3, 2, 4])
    row = metrics.ohlc_volatility(bars).first()
    assert row.parkinson_vol is None and row.yz_vol is None and row.ewma_vol > 0 and row.mad_vol > 0


def test_registry(small):
    assert metrics.metric_choices() == sorted(metrics.METRICS) and len(metrics.METRICS) == 11
    metrics.register_metric("last", lambda bars: bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("last")))
    try:
        assert values(metrics.compute("last", small), "last") == {"A": 120.0, "B": 58.0}
    finally:
        del metrics.METRICS["last"]
    with pytest.raises(ValidationError):
        metrics.compute("nothing", small)
    assert metrics.display_name("cc_vol") == "Close-to-Close Volatility" and metrics.display_name("my_own") == "My Own"


def test_plugins(tmp_path):
    (tmp_path / "good.py").write_text("METRICS = {'plug': lambda bars, params: bars}\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError\n")
    (tmp_path / "_skipped.py").write_text("METRICS = {'no': None}\n")
    try:
        assert metrics.discover_plugins(str(tmp_path)) == ["plug"]
    finally:
        metrics.METRICS.pop("plug", None)


def test_plans_have_no_python(spark):
    from quantide.sources.readers import synthetic_bars

    plan = metrics.all_metrics(synthetic_bars(spark, 50, ["A", "B"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert metrics.all_metrics(synthetic_bars(spark, 50, ["A", "B"])).count() == 2


def test_scale_invariance(spark, small):
    scaled = small.withColumn("close", F.col("close") * 7.5)
    a, b = (sorted((r.ticker, str(r.date), round(r.daily_return, 10)) for r in returns.daily_returns(x).collect()) for x in (small, scaled))
    assert a == b
