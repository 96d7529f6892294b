"""Sector-relative composite health scores of companies.

Stages: fill by the sector's median, smooth per company, winsorise and scale within the
sector, align directions, score (supervised, by principal components, or by the
equal-weight fallback), rescale. No stage gathers a sector in one task: covariances and the sums
of Newton's steps are aggregates by sector, joined back; quantiles and ranks are exact ones by value
blocks (``order_stats``). What is solved in Python is one small matrix per sector. Panels are
written where two passes would compute them twice.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantide.functions.shared import written
from quantide.operators.order_stats import average_ranks, block_quantiles, quantiles, value_blocks

#: sectors whose aggregates are broadcast; beyond it they are joined by a shuffle
BROADCAST_SECTORS = 20_000


def by_sector(panel: DataFrame, small: DataFrame) -> DataFrame:
    """The panel with the columns of a table that has one row per sector (named _s)."""
    # written once, so that its rows are counted and joined without computing the panel again
    small = written(small, "sectors")
    few = small.limit(BROADCAST_SECTORS + 1).count() <= BROADCAST_SECTORS
    return panel.join(F.broadcast(small) if few else small, F.col("sector").eqNullSafe(F.col("_s")), "left").drop("_s")


def imputed(panel: DataFrame, features: list[str]) -> DataFrame:
    j = _with_quantiles(panel, features, [0.5])
    return j.withColumns({f: F.coalesce(F.col(f), F.col(f"{f}_q")[0]) for f in features}).select(panel.columns)


def smoothed(panel: DataFrame, features: list[str], window: int = 4) -> DataFrame:
    w = Window.partitionBy("company").orderBy("date").rowsBetween(-(window - 1), 0)
    return panel.withColumns({f: F.avg(f).over(w) for f in features})


def _clipped(f: str) -> Column:
    """A value between the first two of its quantiles; null stays null."""
    return F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.col(f"{f}_q")[0]), F.col(f"{f}_q")[1]))


def _sector_quantiles(panel: DataFrame, features: list[str], qs: list[float], clipped: list[float] | None = None) -> DataFrame:
    """_s and <feature>_q: quantiles; joined back, a sector has one row here whatever its size."""
    long = panel.select(F.col("sector").alias("_s"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("_s", "x.*")
    q = quantiles(long, ["_s", "feature"], qs, clipped=clipped)
    # a row for each feature of a sector
    return q.groupBy("_s").agg(*[F.any_value(F.when(F.col("feature") == f, F.col("q")), ignoreNulls=True).alias(f"{f}_q") for f in features])


def _with_quantiles(panel: DataFrame, features: list[str], qs: list[float]) -> DataFrame:
    return by_sector(panel, _sector_quantiles(panel, features, qs))


def winsorised(panel: DataFrame, features: list[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    j = _with_quantiles(panel, features, [lower, upper])
    return j.withColumns({f: _clipped(f) for f in features}).select(panel.columns)


def _iqr(f: str, at: int = 0) -> Column:
    d = F.col(f"{f}_q")[at + 2] - F.col(f"{f}_q")[at]
    return F.when(d.isNull() | (d == 0), F.lit(1.0)).otherwise(d)


def scaled(panel: DataFrame, features: list[str]) -> DataFrame:
    j = _with_quantiles(panel, features, [0.25, 0.5, 0.75])
    return j.withColumns({f: (F.col(f) - F.col(f"{f}_q")[1]) / _iqr(f) for f in features}).select(panel.columns)


def winsorised_and_scaled(panel: DataFrame, features: list[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """What ``scaled`` gives after ``winsorised``, with one pass for the quantiles of both."""
    j = by_sector(panel, _sector_quantiles(panel, features, [lower, upper], [0.25, 0.5, 0.75]))
    return j.withColumns({f: (_clipped(f) - F.col(f"{f}_q")[3]) / _iqr(f, 2) for f in features}).select(panel.columns)


def scale_params(panel: DataFrame, features: list[str]) -> DataFrame:
    """sector, feature, median and iqr as ``scaled`` uses them."""
    q = _sector_quantiles(panel, features, [0.25, 0.5, 0.75])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_q")[1].alias("median"), _iqr(f).alias("iqr")) for f in features])
    return q.select(F.col("_s").alias("sector"), F.explode(rows).alias("x")).select("sector", "x.*")


def aligned(panel: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    return panel.withColumns({f: F.col(f) * (1.0 if up else -1.0) for f, up in higher_is_better.items()})


def percent_ranked(panel: DataFrame, c: str, name: str) -> DataFrame:
    """Add the rank in the sector in percent, equal values at their average rank; nulls rank first."""
    return average_ranks(written(panel, "ranking"), ["sector"], c).withColumn(name, 100 * F.col("_rank") / F.col("_total")).drop("_rank", "_total")


def fallback_scores(panel: DataFrame, features: list[str]) -> DataFrame:
    """The equal-weight score: every row of a sector has the same raw value, so all share the average rank."""
    n = panel.groupBy(F.col("sector").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    out = by_sector(panel, n).withColumn("score", 100 * (F.col("_n") + 1) / (2 * F.col("_n"))).drop("_n")
    return out.withColumns({f"contrib_{f}": F.col(f) for f in features})


def components(panel: DataFrame, features: list[str], variance: float = 0.7) -> DataFrame:
    """_s, means, loadings (one array per component) and ratios of the first components of each sector's covariance that explain ``variance``.

    Sums of products are aggregates; only a sector's matrix of them comes to a Python task. Sectors with fewer than two rows or a null feature have none.
    A component's sign makes its largest loading positive.
    """
    names = [(a, b) for k, a in enumerate(features) for b in features[k:]]
    g = panel.groupBy(F.col("sector").alias("_s")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in names]).alias("cov"),
        F.min(reduce(lambda x, y: x & y, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])).alias("whole"),
    )

    def solve(frames):
        for frame in frames:
            out = {"_s": [], "means": [], "loadings": [], "ratios": []}
            for r in frame.itertuples(index=False):
                if r.n < 2 or not r.whole or not np.isfinite(r.cov).all():
                    continue
                m = np.zeros((len(features), len(features)))
                for (a, b), v in zip(names, r.cov, strict=True):
                    m[features.index(a), features.index(b)] = m[features.index(b), features.index(a)] = v
                values, vectors = np.linalg.eigh(m)
                values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
                ratio = values / max(values.sum(), 1e-300)
                k = min(int(np.searchsorted(np.cumsum(ratio), variance)) + 1, len(values))
                top = vectors[:k] * np.sign(vectors[:k][np.arange(k), np.abs(vectors[:k]).argmax(axis=1)])[:, None]
                for to, v in zip(out.values(), (r[0], list(r.means), [list(x) for x in top], list(ratio[:k])), strict=True):
                    to.append(v)
            if out["_s"]:
                yield pd.DataFrame(out)

    return g.select("_s", "n", "means", "cov", "whole").mapInPandas(solve, "_s string, means array<double>, loadings array<array<double>>, ratios array<double>")


def pca_scores(panel: DataFrame, features: list[str], variance: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Variance-weighted sum of the first components that explain ``variance``, clipped at its sector's 2nd and 98th percentile and ranked there.

    ``keep`` names the panel's columns to keep, all by default, the sector among them. The panel is read twice.
    """
    keep = panel.columns if keep is None else keep
    small = written(components(panel, features, variance), "loadings")
    # a column for each number, up to the most components of a sector: generated code stays short, where functions on arrays run outside it
    ks, js = range(len(features)), range(small.agg(F.max(F.size("loadings"))).first()[0] or 1)
    number = lambda *at: reduce(lambda x, k: F.get(x, F.lit(k)), at[1:], F.col(at[0]))
    numbers = {f"_m{k}": number("means", k) for k in ks} | {f"_r{j}": number("ratios", j) for j in js} | {f"_l{j}_{k}": number("loadings", j, k) for j in js for k in ks}
    x = by_sector(panel, small.select("_s", *[c.alias(name) for name, c in numbers.items()]))
    total = lambda terms: reduce(lambda a, b: a + b, terms, F.lit(0.0))
    x = x.withColumns({f"_c{k}": F.col(f) - F.col(f"_m{k}") for k, f in enumerate(features)})
    x = x.withColumns({f"_pc{j}": total(F.col(f"_l{j}_{k}") * F.col(f"_c{k}") for k in ks) for j in js})
    # a sector has the first component, or none; it may have fewer than others
    along = lambda name: total(t if j == 0 else F.coalesce(t, F.lit(0.0)) for j in js for t in [F.col(f"_pc{j}") * F.col(name.format(j=j))])
    # what a feature has of the row's position along the components
    back = {f"contrib_{f}": along(f"_l{{j}}_{k}") for k, f in enumerate(features)}
    x = written(x.select(*keep, along("_r{j}").alias("_raw"), *[c.alias(name) for name, c in back.items()]), "components")
    # the values are counted once, for quantiles and ranks
    blocks = value_blocks(x, ["sector"], "_raw", "raw")
    q = written(block_quantiles(blocks.where("_raw IS NOT NULL"), ["sector"], [0.02, 0.98], "_raw").select(F.col("sector").alias("_s"), F.col("q").alias("_raw_q")), "limits")
    clip = lambda df: by_sector(df, q).withColumn("_raw", _clipped("_raw")).drop("_raw_q")
    out = average_ranks(clip(x), ["sector"], "_raw", clip(blocks.drop("_block"))).withColumn("score", F.when(F.col("_raw").isNotNull(), 100 * F.col("_rank") / F.col("_total")))
    return out.select(*keep, "score", *back)


def logit_models(rows: DataFrame, features: list[str], label: str, folds: int, c: float = 1.0, steps: int = 25) -> DataFrame:
    """_s, model and w: weights and intercept of balanced L2 logistic regressions per sector, by Newton's steps.

    Model m < ``folds`` leaves out the rows of that fold, model ``folds`` none. A step is one aggregate of sums over rows; the systems of equations, one
    per sector and model, are solved in Python. Models with one class have no row.
    """
    d = len(features) + 1
    x = rows.select(F.col("sector").alias("_s"), "_fold", F.col(label).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0)).alias("x"))
    x = written(x, "logit").withColumn("model", F.explode(F.array_remove(F.array(*[F.lit(k) for k in range(folds + 1)]), F.col("_fold"))))
    sizes = x.groupBy("_s", "model").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("pos")).where("pos > 0 and pos < n")
    weights = sizes.withColumn("w", F.array(*[F.lit(0.0)] * d))
    ridge, known = np.append(np.ones(d - 1) / c, 0.0), []

    def step(frames):
        for frame in frames:
            solved = []
            for r in frame.itertuples(index=False):
                w, h, g = np.array(r.w), np.zeros((d, d)), np.array(r.g)
                h[np.triu_indices(d)] = r.h
                h = h + np.triu(h, 1).T
                solved.append((w - np.linalg.solve(h + np.diag(ridge + 1e-9), g + ridge * w)).tolist())
            yield frame[["_s", "model", "n", "pos"]].assign(w=solved)

    for _ in range(steps):
        j = x.join(F.broadcast(weights.withColumnsRenamed({"_s": "s2", "model": "m2"})), F.col("_s").eqNullSafe(F.col("s2")) & (F.col("model") == F.col("m2")))
        z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        j = j.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).withColumn("v", F.when(F.col("y") == 1, F.col("n") / (2 * F.col("pos"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("pos")))))
        hs = [F.sum(F.col("v") * F.col("p") * (1 - F.col("p")) * F.col("x")[a] * F.col("x")[b]) for a in range(d) for b in range(a, d)]
        gs = [F.sum(F.col("v") * (F.col("p") - F.col("y")) * F.col("x")[a]) for a in range(d)]
        sums = j.groupBy("_s", "model").agg(F.any_value("n").alias("n"), F.any_value("pos").alias("pos"), F.any_value("w").alias("w"), F.array(*hs).alias("h"), F.array(*gs).alias("g"))
        # a few numbers per sector and model: they are fixed on the driver between steps, up to the bound of what is broadcast
        found = sums.mapInPandas(step, "_s string, model int, n double, pos double, w array<double>").limit(BROADCAST_SECTORS * (folds + 1) + 1).collect()
        if len(found) > BROADCAST_SECTORS * (folds + 1):
            raise ValueError("too many sectors for supervised scores")
        before = {(r["_s"], r.model): r.w for r in known}
        known = found
        weights = rows.sparkSession.createDataFrame(found, "_s string, model int, n double, pos double, w array<double>")
        if all((k := (r["_s"], r.model)) in before and max(abs(a - b) for a, b in zip(r.w, before[k], strict=True)) < 1e-9 for r in found):
            break
    return weights.select("_s", "model", "w")


def logit_scores(panel: DataFrame, features: list[str], label: str = "label", folds: int = 5, seed: int = 42, steps: int = 25) -> DataFrame:
    """100 * (1 - probability of the label), out of fold where the sector has rows enough; null for sectors with one class or a missing value.

    Folds are hashes of company and date, so they don't depend on the order of rows.
    """
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features], F.col(label).isNotNull())
    facts = panel.groupBy(F.col("sector").alias("_s")).agg(F.min(whole).alias("_whole"), F.count(F.lit(1)).alias("_n"))
    rows = by_sector(panel, facts).withColumn("_fold", F.when(F.col("_n") >= folds + 2, F.pmod(F.xxhash64(F.lit(seed), "company", "date"), F.lit(folds)).cast("int")).otherwise(F.lit(-1)))
    models = logit_models(rows.where("_whole"), features, label, folds, steps=steps)
    packed = models.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("model", "w"))).alias("_w"))
    j = by_sector(rows, packed)
    last = F.try_element_at("_w", F.lit(folds))
    w = F.coalesce(F.try_element_at("_w", F.col("_fold")), last)
    x = F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0))
    z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    score = F.when(last.isNotNull(), 100 * (1 - 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))))
    return j.select(*panel.columns, score.alias("score"), *[(F.col(f) * last[k]).alias(f"contrib_{f}") for k, f in enumerate(features)])


def with_bootstrap(scored: DataFrame) -> DataFrame:
    """health_se: what resampling a sector's scores gives as the deviation at each position, in expectation.

    A draw with replacement has the sector's scores as its distribution, so that is their population deviation; below five rows the sample's, 0 for one row.
    """
    g = scored.groupBy(F.col("sector").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("score").alias("_pop"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("_samp"))
    return by_sector(scored, g).withColumn("health_se", F.when(F.col("_n") < 5, F.col("_samp")).otherwise(F.col("_pop"))).drop("_n", "_pop", "_samp")


def model_info(panel: DataFrame, features: list[str], higher_is_better: dict[str, bool] | None = None, label: str | None = None, mode: str = "pca", variance: float = 0.7) -> DataFrame:
    """How ``health_scores`` comes to its scores: sector, feature, median, iqr, multiplier, mode, rows, and the number and share of variance of the components used (null in other modes)."""
    up = higher_is_better or dict.fromkeys(features, True)
    panel = written(panel, "panel")
    out = winsorised(written(smoothed(imputed(panel, features), features), "smoothed"), features)
    signs = F.create_map(*[F.lit(v) for f in features for v in (f, 1.0 if up[f] else -1.0)])
    kind = "supervised" if label is not None and not panel.where(F.col(label).isNotNull()).isEmpty() else mode
    rows = panel.groupBy(F.col("sector").alias("_s")).agg(F.count(F.lit(1)).alias("rows"))
    info = by_sector(scale_params(out, features), rows).withColumn("multiplier", signs[F.col("feature")]).withColumn("mode", F.lit(kind))
    if kind != "pca":
        return info.withColumn("components", F.lit(None).cast("int")).withColumn("explained", F.lit(None).cast("double"))
    used = components(prepared(panel, features, up), features, variance)
    used = used.select("_s", F.size("ratios").alias("components"), F.aggregate("ratios", F.lit(0.0), lambda s, v: s + v).alias("explained"))
    return by_sector(info, used)


def rescaled(scored: DataFrame) -> DataFrame:
    """health_score: the score clipped to its 1st and 99th percentile over all rows, put on 0 to 100."""
    scored = written(scored, "scores")
    return scored.withColumn("health_score", _on_100(scored))


def _on_100(scored: DataFrame) -> Column:
    """health_score of the scores, which are read now."""
    q = quantiles(scored.select(F.lit(0).alias("k"), "score"), ["k"], [0.01, 0.99], "score").first()
    lo, hi = (F.lit(v).cast("double") for v in (q["q"] if q else (None, None)))
    clipped = F.when(F.col("score").isNotNull(), F.least(F.greatest(F.col("score"), lo), hi))
    return (clipped - lo) / F.greatest(hi - lo, F.lit(1e-9)) * 100


def prepared(panel: DataFrame, features: list[str], higher_is_better: dict[str, bool] | None = None, smooth: int | None = 4, winsorise: bool = True) -> DataFrame:
    out = imputed(written(panel, "panel"), features)
    out = written(smoothed(out, features, smooth) if smooth else out, "smoothed")
    out = winsorised_and_scaled(out, features) if winsorise else scaled(out, features)
    return aligned(out, higher_is_better or dict.fromkeys(features, True))


def health_scores(panel: DataFrame, features: list[str], higher_is_better: dict[str, bool] | None = None, label: str | None = None, mode: str = "pca", bootstrap: bool = True) -> DataFrame:
    """The panel's keys with health_score, health_se and contributions. Mode: pca or equal; a label means supervised."""
    ready = written(prepared(panel, features, higher_is_better), "prepared")
    if label is not None and not panel.where(F.col(label).isNotNull()).isEmpty():
        scored = logit_scores(ready, features, label)
    else:
        scored = pca_scores(ready, features, keep=["company", "date", "sector"]) if mode == "pca" else fallback_scores(ready, features)
    scored = written(scored.select("company", "date", "sector", "score", *[f"contrib_{f}" for f in features]), "scores")
    out = with_bootstrap(scored) if bootstrap else scored.withColumn("health_se", F.lit(0.0))
    return out.withColumn("health_score", _on_100(scored)).select("company", "date", "sector", "health_score", "health_se", *[f"contrib_{f}" for f in features])
