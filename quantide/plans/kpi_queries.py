"""The composite score's stages, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantide.operators import kpi
from quantide.plans import inputs as I
from quantide.plans.metric_queries import rounded
from quantide.streaming import bars as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
FS = I.FEATURES
UP = {"n_orders": True, "revenue": True, "largest": False, "balance": True}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _each(expr: str, source: str) -> str:
    cols = ", ".join(f"{expr.format(f=f)} AS {f}" for f in FS)
    return f"SELECT company, date, sector, {cols} FROM {source}"


def _out(source: str) -> str:
    return f"SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, " + ", ".join(f"round({f}, 6) AS {f}" for f in FS) + f" FROM {source}"


_W = "OVER (PARTITION BY sector)"
_IMP = f"{I.PANEL}, imp AS ({_each('coalesce({f}, median({f}) ' + _W + ')', 'panel')})"
_SMO = f"{_IMP}, smo AS ({_each('avg({f}) OVER (PARTITION BY company ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'imp')})"
_WIN = f"{_SMO}, win AS ({_each('least(greatest({f}, quantile_cont({f}, 0.01) ' + _W + '), quantile_cont({f}, 0.99) ' + _W + ')', 'smo')})"
_IQR = "quantile_cont({f}, 0.75) " + _W + " - quantile_cont({f}, 0.25) " + _W
_SCA = f"{_WIN}, sca AS ({_each('({f} - median({f}) ' + _W + ') / CASE WHEN (' + _IQR + ') = 0 THEN 1 ELSE ' + _IQR + ' END', 'win')})"
_ALI = f"{_SCA}, ali AS (SELECT company, date, sector, n_orders, revenue, -largest AS largest, balance FROM sca)"


def _ready(s, d):
    return kpi.prepared(I.panel(s, d), FS, UP)


query("kpi_impute", f"WITH {_IMP} {_out('imp')}")(lambda s, d: kpi.imputed(I.panel(s, d), FS))
query("kpi_smooth", f"WITH {_SMO} {_out('smo')}")(lambda s, d: kpi.smoothed(kpi.imputed(I.panel(s, d), FS), FS))
query("kpi_winsorize", f"WITH {_WIN} {_out('win')}")(lambda s, d: kpi.winsorised(kpi.smoothed(kpi.imputed(I.panel(s, d), FS), FS), FS))
query("kpi_robust_scale", f"WITH {_ALI} {_out('ali')}")(_ready)
query("kpi_scale_params", f"""WITH {_WIN}, u AS (UNPIVOT (SELECT sector, {', '.join(FS)} FROM win) ON {', '.join(FS)} INTO NAME feature VALUE v)
SELECT sector, feature, round(median(v), 6) AS median, round(CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) = 0 THEN 1 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END, 6) AS iqr FROM u GROUP BY ALL""")(
    lambda s, d: kpi.scale_params(kpi.winsorised(kpi.smoothed(kpi.imputed(I.panel(s, d), FS), FS), FS), FS)
)
_PCT = "round(100.0 * (rank() OVER (PARTITION BY sector ORDER BY revenue) + (count(*) OVER (PARTITION BY sector, revenue) - 1) / 2.0) / count(*) OVER (PARTITION BY sector), 6)"
query("kpi_percent_rank", f"WITH {I.PANEL} SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, {_PCT} AS score FROM panel")(lambda s, d: kpi.percent_ranked(I.panel(s, d), "revenue", "score").select("company", "date", "sector", "score"))
query("kpi_rank_fallback", f"WITH {I.PANEL} SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, round(100.0 * (count(*) {_W} + 1) / (2.0 * count(*) {_W}), 6) AS score FROM panel")(
    lambda s, d: kpi.fallback_scores(_ready(s, d), FS).select("company", "date", "sector", "score")
)
query("kpi_final_scale", f"""WITH {_SCA}, q AS (SELECT quantile_cont(revenue, 0.01) AS lo, quantile_cont(revenue, 0.99) AS hi FROM sca)
SELECT company, strftime(date, '%Y-%m-%d') AS date, round((least(greatest(revenue, lo), hi) - lo) / greatest(hi - lo, 1e-9) * 100, 6) AS health_score FROM sca CROSS JOIN q""")(
    lambda s, d: kpi.rescaled(_ready(s, d).withColumn("score", F.col("revenue"))).select("company", "date", "health_score")
)
query("kpi_pca")(lambda s, d: kpi.health_scores(I.panel(s, d), FS, UP))
query("kpi_logit")(lambda s, d: kpi.logit_scores(_ready(s, d).join(I.panel(s, d).select("company", "date", (F.col("revenue") < 150000).cast("int").alias("label")), ["company", "date"]), FS).select("company", "date", "sector", "score"))
query("kpi_bootstrap", f"WITH {_ALI} SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, round(revenue, 6) AS score, round(CASE WHEN count(*) {_W} < 5 THEN coalesce(stddev_samp(revenue) {_W}, 0) ELSE stddev_pop(revenue) {_W} END, 6) AS health_se FROM ali")(lambda s, d: kpi.with_bootstrap(_ready(s, d).select("company", "date", "sector", F.col("revenue").alias("score"))))

query("kpi_model_info", f"""WITH {_WIN}, u AS (UNPIVOT (SELECT sector, {', '.join(FS)} FROM win) ON {', '.join(FS)} INTO NAME feature VALUE v)
SELECT sector, feature, round(median(v), 6) AS median, round(CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) = 0 THEN 1 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END, 6) AS iqr,
       count(*) AS rows, CASE WHEN feature = 'largest' THEN -1.0 ELSE 1.0 END AS multiplier, 'equal' AS mode FROM u GROUP BY ALL""")(
    lambda s, d: kpi.model_info(I.panel(s, d), FS, UP, mode="equal").drop("components", "explained")
)


# -- models, of one or two features: these have closed forms -----------------------------
_TWO = ["n_orders", "revenue"]
_COMP = f"""{_ALI}, cov AS (SELECT sector, avg(n_orders) AS m1, avg(revenue) AS m2, var_pop(n_orders) AS a, covar_pop(n_orders, revenue) AS b, var_pop(revenue) AS c FROM ali GROUP BY sector),
eig AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM cov),
vec AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS x, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS y, l1 / (l1 + l2) AS ratio FROM eig),
com AS (SELECT sector, m1, m2, ratio, x * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS v1, y * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS v2 FROM vec)"""
query("kpi_components", f"WITH {_COMP} SELECT sector, round(v1, 6) AS n_orders, round(v2, 6) AS revenue, round(ratio, 6) AS ratio FROM com")(
    lambda s, d: kpi.components(_ready(s, d), _TWO, 0.01).select(F.col("_s").alias("sector"), F.col("loadings")[0][0].alias("n_orders"), F.col("loadings")[0][1].alias("revenue"), F.col("ratios")[0].alias("ratio"))
)
query("kpi_pca_scores", f"""WITH {_COMP}, raw AS (SELECT company, date, sector, (v1 * (n_orders - m1) + v2 * (revenue - m2)) AS pc, ratio, v1, v2 FROM ali JOIN com USING (sector)),
cut AS (SELECT *, least(greatest(pc * ratio, quantile_cont(pc * ratio, 0.02) {_W}), quantile_cont(pc * ratio, 0.98) {_W}) AS r FROM raw)
SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, round(100.0 * (rank() OVER (PARTITION BY sector ORDER BY r) + (count(*) OVER (PARTITION BY sector, r) - 1) / 2.0) / count(*) {_W}, 6) AS score,
       round(pc * v1, 6) AS contrib_n_orders, round(pc * v2, 6) AS contrib_revenue FROM cut""")(
    lambda s, d: kpi.pca_scores(_ready_two(s, d), _TWO, 0.01, keep=["company", "date", "sector"])
)


def _ready_two(s, d):
    """All rows, with the two features scored: each is prepared by itself."""
    return kpi.prepared(I.panel(s, d).select("company", "date", "sector", *_TWO), _TWO, {f: UP[f] for f in _TWO})


def _newton(steps: int) -> str:
    """SQL of Newton's steps of a balanced logistic regression with one feature f."""
    out = []
    for k in range(steps):
        out.append(f"""w{k + 1} AS MATERIALIZED (SELECT sector, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
  SELECT sector, a, b, sum(v * p * (1 - p) * f * f) + 1 + 1e-9 AS h11, sum(v * p * (1 - p) * f) AS h12, sum(v * p * (1 - p)) + 1e-9 AS h22, sum(v * (p - y) * f) + a AS g1, sum(v * (p - y)) AS g2
  FROM (SELECT x.*, a, b, 1 / (1 + exp(-least(greatest(a * f + b, -30), 30))) AS p FROM x JOIN w{k} USING (sector)) GROUP BY sector, a, b))""")
    return ", ".join(out)


query("kpi_logit_weights", f"""WITH {_ALI}, l AS (SELECT ali.sector, ali.n_orders AS f, (panel.revenue < 150000)::INT AS y FROM ali JOIN panel USING (company, date)),
n AS (SELECT sector, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM l GROUP BY sector HAVING sum(y) > 0 AND sum(y) < count(*)),
x AS MATERIALIZED (SELECT l.*, CASE WHEN y = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS v FROM l JOIN n USING (sector)),
w0 AS MATERIALIZED (SELECT sector, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM n), {_newton(25)}
SELECT sector, round(a, 6) AS slope, round(b, 6) AS intercept FROM w25""")(
    lambda s, d: kpi.logit_models(_labelled(s, d).withColumn("_fold", F.lit(-1)), ["n_orders"], "label", 0).select(F.col("_s").alias("sector"), F.col("w")[0].alias("slope"), F.col("w")[1].alias("intercept"))
)


def _labelled(s, d):
    return _ready(s, d).join(I.panel(s, d).select("company", "date", (F.col("revenue") < 150000).cast("int").alias("label")), ["company", "date"])


@query("stream_bars", f"WITH {I.DENSE} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(\"close\", 6) AS \"close\", volume FROM bars")
def _stream(s, d):
    schema = ", ".join(f"{c} {t}" for c, t in I.read(s, d, "events").dtypes)
    # the pattern keeps to the one table, be it a file or a folder
    ticks = S.tick_stream(s, f"{d}/events.parque[t]", schema).withColumnRenamed("event_type", "ticker")
    name = f"bars_{uuid.uuid4().hex}"
    return S.run_to_table(S.streaming_bars(ticks), name, S.state_folder(s, name))
