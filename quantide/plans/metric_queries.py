"""Bars, returns, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantide.operators import bars as B
from quantide.operators import metrics, universe
from quantide.operators import returns as R
from quantide.params import MetricParams
from quantide.plans import inputs as I


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, dates and stamps as text, so that results compare across engines."""
    out = {c: F.round(c, places) for c, t in df.dtypes if t == "double"}
    out |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t.startswith("timestamp")}
    out |= {c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"}
    return df.withColumns(out)


def _stamp(c: str, name: str = "") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_BAR_COLUMNS = f"ticker, {_stamp('ts')}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(\"close\", 6) AS \"close\", volume"
query("bars_daily", f"WITH {I.DENSE} SELECT {_BAR_COLUMNS} FROM bars")(I.dense)
query("bars_hourly", f"WITH {I.HOURLY} SELECT {_BAR_COLUMNS} FROM bars")(lambda s, d: B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type"))
query("bars_weekly_brands", f"WITH {I.BRANDS} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\" FROM bars")(I.brands)
query("daily_returns", f"WITH {I.SPARSE}, {I.GRID} SELECT {_stamp('ts', 'date')}, ticker, round(r, 6) AS daily_return FROM rets WHERE r IS NOT NULL")(lambda s, d: R.daily_returns(I.sparse(s, d)))
query(
    "compressed_returns",
    f"WITH {I.SPARSE} SELECT ticker, {_stamp('ts')}, round(x, 6) AS x FROM (SELECT ticker, ts, ln(\"close\" / lag(\"close\") OVER (PARTITION BY ticker ORDER BY ts)) AS x FROM bars) WHERE x IS NOT NULL",
)(lambda s, d: R.close_frame(I.sparse(s, d)).withColumn("x", F.ln(F.try_divide(F.col("px"), F.lag("px").over(R.by_time())))).where("x is not null").select("ticker", "ts", "x"))

_CC = "SELECT ticker, round(stddev_samp(lr) * sqrt({ppy}), 6) AS cc_vol FROM rets GROUP BY ticker"
query("cc_vol", f"WITH {I.DENSE}, {I.GRID} {_CC.format(ppy=252)}")(lambda s, d: metrics.compute("cc_vol", I.dense(s, d)))
query("cc_vol_sparse", f"WITH {I.SPARSE}, {I.GRID} {_CC.format(ppy=252)}")(lambda s, d: metrics.compute("cc_vol", I.sparse(s, d)))
query("cc_vol_hourly", f"WITH {I.HOURLY}, {I.GRID} {_CC.format(ppy=1638)}")(lambda s, d: metrics.compute("cc_vol", B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type"), MetricParams(interval="1h")))
query("cc_vol_min_periods", f"WITH {I.SPARSE}, {I.GRID} {_CC.format(ppy=252)} HAVING count(lr) >= 22")(lambda s, d: metrics.compute("cc_vol", I.sparse(s, d), MetricParams(min_periods=22)))

_DD = "dd AS (SELECT ticker, ts, \"close\" / max(\"close\") OVER (PARTITION BY ticker ORDER BY ts) - 1 AS drawdown FROM bars)"
query("max_drawdown", f"WITH {I.SPARSE}, {_DD} SELECT ticker, round(min(drawdown), 6) AS max_drawdown FROM dd GROUP BY ticker")(lambda s, d: metrics.compute("max_drawdown", I.sparse(s, d)))
query("drawdown_series", f"WITH {I.DENSE}, {_DD} SELECT {_stamp('ts', 'date')}, ticker, round(drawdown, 6) AS drawdown FROM dd")(lambda s, d: R.drawdowns(I.dense(s, d)))


def _rolling_sql(bars: str, windows: tuple[int, ...]) -> str:
    parts = [
        f"SELECT {_stamp('ts', 'date')}, ticker, {k} AS \"window\", round(v, 6) AS rolling_volatility FROM (SELECT ts, ticker, CASE WHEN count(lr) OVER w = {k} THEN stddev_samp(lr) OVER w * sqrt(252) END AS v FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL"
        for k in windows
    ]
    return f"WITH {bars}, {I.GRID} " + " UNION ALL ".join(parts)


query("rolling_volatility", _rolling_sql(I.BRANDS, (30, 60, 90)))(lambda s, d: R.rolling_volatility(I.brands(s, d)))
query("rolling_volatility_gaps", _rolling_sql(I.SPARSE, (5, 10)))(lambda s, d: R.rolling_volatility(I.sparse(s, d), (5, 10)))

def _complete_sql(bars: str, expr: str) -> str:
    """One row per instrument, null where no date is complete."""
    return f"WITH {bars}, {I.GRID}, {I.COMPLETE}, k AS (SELECT ticker, {expr} FROM cc GROUP BY ticker) SELECT * FROM (SELECT DISTINCT ticker FROM bars) LEFT JOIN k USING (ticker)"


_SHARPE = "round(avg(r - {rf} / 252) / stddev_samp(r) * sqrt(252), 6) AS sharpe_ratio"
_VAR = "round(quantile_cont(r, {q}), 6) AS var"
_SORTINO = "round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 6) AS sortino"
for _name, _expr, _params in (("sharpe_ratio", _SHARPE.format(rf=0.0), MetricParams()), ("var", _VAR.format(q=0.05), MetricParams()), ("sortino", _SORTINO, MetricParams())):
    _sql = _complete_sql(I.DENSE, _expr)
    query({"var": "value_at_risk", "sortino": "sortino_ratio"}.get(_name, _name), _sql)(lambda s, d, n=_name, p=_params: metrics.compute(n, I.dense(s, d), p))
query("sharpe_complete_case_hole", _complete_sql(I.HOLED, _SHARPE.format(rf=0.02)))(lambda s, d: metrics.compute("sharpe_ratio", I.holed(s, d), MetricParams(risk_free=0.02)))
query("value_at_risk_brands", _complete_sql(I.BRANDS, _VAR.format(q=0.01)))(lambda s, d: metrics.compute("var", I.brands(s, d), MetricParams(confidence=0.01)))


def _ohlc_sql(bars: str, least: int, ppy: float = 252) -> str:
    return f"""WITH {bars}, x AS (
  SELECT ticker, ts, open AS o, high AS h, low AS l, "close" AS c, lag("close") OVER (PARTITION BY ticker ORDER BY ts) AS pc FROM bars
), y AS (SELECT *, ln(c / pc) AS r, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM x
), m AS (SELECT ticker, median(r) AS med FROM y GROUP BY ticker
), g AS (
  SELECT ticker, count(*) AS n, count(r) AS nr, CASE WHEN count(r) = 1 THEN sum(r * r) ELSE var_samp(r) END AS seed,
         coalesce(sum(CASE WHEN {least} = 0 OR rn <= {least} THEN pow(0.94, rn - 1) * r * r END), 0) AS ew, median(abs(r - med)) AS mad,
         avg(ln(h / l) ** 2) AS hl, avg(ln(c / o) ** 2) AS co, avg(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)) AS rs, var_samp(ln(o / pc)) AS vo, var_samp(ln(c / o)) AS vc
  FROM y JOIN m USING (ticker) GROUP BY ticker HAVING count(*) >= {least}
), v AS (
  SELECT *, 0.5 * hl - (2 * ln(2) - 1) * co AS gk, vo + 0.34 * vc + 0.66 * rs AS yz, CASE WHEN {least} = 0 THEN nr ELSE least(nr, {least}) END AS used FROM g
)
SELECT ticker, round(sqrt(hl / (4 * ln(2)) * {ppy}), 6) AS parkinson_vol, round(CASE WHEN gk >= 0 THEN sqrt(gk * {ppy}) END, 6) AS gk_vol,
       round(CASE WHEN rs >= 0 THEN sqrt(rs * {ppy}) END, 6) AS rs_vol, round(CASE WHEN yz >= 0 THEN sqrt(yz * {ppy}) END, 6) AS yz_vol,
       round(CASE WHEN nr >= greatest({least}, 1) THEN sqrt((pow(0.94, used) * seed + 0.06 * ew) * {ppy}) END, 6) AS ewma_vol,
       round(CASE WHEN nr >= greatest({least}, 1) THEN 1.4826 * mad * sqrt({ppy}) END, 6) AS mad_vol
FROM v"""


query("additional_volatility", _ohlc_sql(I.DENSE, 0))(lambda s, d: metrics.ohlc_volatility(I.dense(s, d)))
query("additional_volatility_sparse", _ohlc_sql(I.SPARSE, 20))(lambda s, d: metrics.ohlc_volatility(I.sparse(s, d), MetricParams(min_periods=20)))
for _k in metrics.OHLC:
    query(_k, f"SELECT ticker, {_k} FROM ({_ohlc_sql(I.DENSE, 10)})")(lambda s, d, k=_k: metrics.compute(k, I.dense(s, d), MetricParams(min_periods=10)))

query(
    "ranking_left",
    f"WITH {I.DENSE}, {I.GRID}, {I.EVENT_UNIVERSE}, m AS ({_CC.format(ppy=252)}) SELECT rank, company, m.ticker, cc_vol FROM m LEFT JOIN univ ON univ.ticker = m.ticker WHERE cc_vol IS NOT NULL",
)(lambda s, d: universe.rank_by("cc_vol", I.dense(s, d), I.event_universe(s, d)))
query(
    "ranking_inner_all_metrics",
    f"""WITH {I.EVENT_UNIVERSE}, o AS ({_ohlc_sql(I.DENSE, 0)}),
c AS (WITH {I.DENSE}, {I.GRID} {_CC.format(ppy=252)}),
k AS (WITH {I.DENSE}, {I.GRID}, {I.COMPLETE} SELECT ticker, {_SHARPE.format(rf=0.0)}, {_VAR.format(q=0.05)}, {_SORTINO} FROM cc GROUP BY ticker),
x AS (WITH {I.DENSE}, {_DD} SELECT ticker, round(min(drawdown), 6) AS max_drawdown FROM dd GROUP BY ticker)
SELECT rank, company, univ.ticker, gk_vol, cc_vol, parkinson_vol, rs_vol, yz_vol, ewma_vol, mad_vol, sharpe_ratio, max_drawdown, var, sortino
FROM univ JOIN o USING (ticker) JOIN c USING (ticker) JOIN k USING (ticker) JOIN x USING (ticker)""",
)(lambda s, d: universe.metric_table("gk_vol", I.dense(s, d), I.event_universe(s, d), titles=False))
query("top_k", f"WITH {I.SPARSE}, {I.GRID} SELECT * FROM ({_CC.format(ppy=252)}) WHERE cc_vol IS NOT NULL ORDER BY cc_vol DESC, ticker LIMIT 5")(
    lambda s, d: metrics.compute("cc_vol", I.sparse(s, d)).orderBy(F.desc_nulls_last("cc_vol"), "ticker").limit(5)
)
