import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantide import params as P
from quantide.operators import annotations, calendar, ingest, kpi, sanitize, universe, validate
from quantide.service import Service
from quantide.sources import fetching, readers, sinks


def bars(spark, rows, schema="ticker string, ts timestamp, close double"):
    return spark.createDataFrame([(t, datetime.fromisoformat(d), float(v)) for t, d, v in rows], schema)


def test_sanitise_short_and_duplicate(spark):
    rows = [(t, f"2024-01-0{i}", i) for t in ("KEEP", "DUPE") for i in range(1, 6)] + [("SHORT", "2024-01-01", 1)]
    b = bars(spark, rows)
    order = spark.createDataFrame([("KEEP", 0), ("DUPE", 1), ("SHORT", 2)], "ticker string, ord int")
    got = {r.ticker: r.status for r in sanitize.sanitise(b, 3, order).collect()}
    assert got == {"KEEP": "kept", "DUPE": "duplicate", "SHORT": "short"}
    assert {r.ticker: r.status for r in sanitize.sanitise(b, 3).collect()}["DUPE"] == "kept"


def test_tail_is_filled_both_ways(spark):
    b = bars(spark, [("A", "2024-01-02", 5), ("A", "2024-01-04", 7), ("B", "2024-01-01", 1), ("B", "2024-01-02", 1), ("B", "2024-01-03", 1), ("B", "2024-01-04", 1)])
    from quantide.operators.returns import close_frame, date_grid

    got = {r.ticker: r.tail for r in sanitize.tails(close_frame(b), date_grid(b), 60).collect()}
    assert got["A"] == [5.0, 5.0, 5.0, 7.0] and got["B"] == [1.0] * 4


def test_fingerprint_clusters(spark):
    day = datetime(2024, 1, 1)
    rows = [(t, (day + timedelta(days=i)).isoformat(), off + i + 1) for t, off in (("AAA", 0), ("BBB", 0), ("CCC", 0), ("DDD", 10)) for i in range(10)]
    got = sanitize.suspect_clusters(bars(spark, rows), 40).collect()
    assert [r.tickers for r in got] == [["AAA", "BBB", "CCC"]]


def test_merge_last_wins(spark):
    got = ingest.merge_incremental(bars(spark, [("A", "2020-01-01", 1), ("A", "2020-01-02", 2)]), bars(spark, [("A", "2020-01-02", 3), ("A", "2020-01-03", 4)]))
    assert [(r.ts.day, r.close) for r in got.orderBy("ts").collect()] == [(1, 1.0), (2, 3.0), (3, 4.0)]


def test_business_day_gaps(spark):
    days = calendar.sessions(spark, date(2020, 1, 1), date(2024, 12, 31))
    ok = bars(spark, [("A", "2024-07-03", 1), ("A", "2024-07-05", 1), ("A", "2024-07-08", 1)])
    assert validate.business_day_gaps(ok, days).count() == 0
    gap = bars(spark, [("A", "2024-07-03", 1), ("A", "2024-07-08", 1)])
    assert [str(r.session) for r in validate.business_day_gaps(gap, days).collect()] == ["2024-07-05"]


def test_intraday_gaps(spark):
    days = calendar.sessions(spark, date(2024, 1, 2), date(2024, 1, 5))
    outside = bars(spark, [("A", "2024-01-02T16:00:00", 1), ("A", "2024-01-02T16:05:00", 1)])
    assert validate.intraday_gaps(outside, days, "1m").count() == 0
    inside = bars(spark, [("A", "2024-01-02T09:30:00", 1), ("A", "2024-01-02T09:32:00", 1)])
    assert [r.ts for r in validate.intraday_gaps(inside, days, "1m").collect()] == [datetime(2024, 1, 2, 9, 31)]
    half = bars(spark, [("A", "2024-01-02T09:30:00", 1), ("A", "2024-01-02T10:30:00", 1)])
    allowed = spark.createDataFrame([(datetime(2024, 1, 2, 10, 0),)], "ts timestamp")
    assert validate.intraday_gaps(half, days, "30m").count() == 1 and validate.intraday_gaps(half, days, "30m", allowed).count() == 0


def test_violations(spark):
    b = bars(spark, [("A", "2024-01-02", 1), ("A", "2024-01-02", float("nan")), ("B", "2024-01-02", 1)])
    m = ingest.manifest(b.where("ticker = 'B'"), "1d", "x").unionByName(ingest.manifest(bars(spark, [("A", "2024-01-01", 1)]), "1d", "x"))
    got = {(r.ticker, r.rule) for r in validate.violations(b, m).collect()}
    assert got == {("A", "duplicate_timestamps"), ("A", "null_values"), ("A", "date_range"), ("A", "row_count")}


def test_fetch_plan(spark):
    stored = bars(spark, [("OLD", "2024-01-10", 1), ("NOW", "2024-01-31", 1)])
    asked = spark.createDataFrame([("OLD",), ("NOW",), ("NEW",)], "ticker string")
    plan = lambda i, force=False: {r.ticker: (str(r.fetch_start), r.needs_fetch) for r in ingest.fetch_plan(asked, stored, F.lit(i), F.lit(date(2024, 1, 31)), force).collect()}
    assert plan("1d") == {"OLD": ("2024-01-11", True), "NOW": ("2024-02-01", False), "NEW": (str(date(2024, 1, 31) - timedelta(days=12775)), True)}
    assert plan("5m")["NOW"] == ("2024-01-31", True)
    assert plan("1d", True)["OLD"] == plan("1d")["NEW"]


def test_universe_alignment(spark):
    raw = spark.createDataFrame([("7", "Berkshire Hathaway", "BRK.B"), ("11", "Apple", "AAPL"), ("x", "Nameless", None), ("12", "Digit", "9X"), ("13", "Apple again", "aapl")], "rank string, company string, ticker string")
    assert [tuple(r) for r in universe.build(raw, 1).collect()] == [(7, "Berkshire Hathaway", "BRK-B")]
    assert [r.ticker for r in universe.build(raw, 10).collect()] == ["BRK-B", "AAPL"]
    unknown = spark.createDataFrame([("AAPL", "Apple", 1), ("ZZZ", "Other", 2)], "ticker string, company string, ord long")
    assert [tuple(r) for r in universe.align(universe.clean(raw), unknown).orderBy("rank").collect()] == [(1, "Apple", "AAPL"), (2, "Other", "ZZZ")]
    assert universe.or_fallback(raw.limit(0), 3).count() == 3


def test_quote_decode(spark):
    quote = {"close": [1.05, 2.05, None, 4.05], "volume": [5]}
    doc = {"chart": {"result": [{"timestamp": [0, 60, 120, 180], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [1.0, None, None, 4.0]}]}}]}}
    payloads = spark.createDataFrame([("A", json.dumps(doc))], "ticker string, payload string")
    got, dropped = readers.repaired_quotes(readers.quote_rows(payloads))
    assert [(r.adj_close, r.close, r.open, r.volume) for r in got.orderBy("ts").collect()] == [(1.0, 1.05, 1.0, 5), (2.05, 2.05, 2.05, 0), (4.0, 4.05, 4.0, 0)]
    assert dropped.count() == 1
    doc["chart"]["result"][0]["indicators"] = {"quote": [{}]}
    with pytest.raises(P.DataSourceError):
        readers.checked_quotes(spark.createDataFrame([("A", json.dumps(doc))], "ticker string, payload string"))


def test_store_round_trip(spark, tmp_path):
    store = readers.BarStore(spark, str(tmp_path))
    assert store.bars("1d").count() == 0
    sinks.save_bars(store, bars(spark, [("A", "2024-01-01", 1), ("A", "2024-01-02", 2)]), "1d", "test")
    sinks.save_bars(store, bars(spark, [("B", "2024-01-01", 5)]), "1d", "test")
    sinks.save_bars(store, bars(spark, [("A", "2024-01-03", 9)]), "1d", "test")
    assert [(r.ticker, r.close) for r in store.bars("1d").orderBy("ticker").collect()] == [("A", 9.0), ("B", 5.0)]
    assert store.tickers("1d") == ["A", "B"] and store.load("B").count() == 1
    assert {r.ticker: r.rows for r in store.manifests().collect()} == {"A": 1, "B": 1}
    with pytest.raises(P.CacheError):
        store.load("C")
    with pytest.raises(P.ValidationError):
        sinks.save_bars(store, bars(spark, [("A", "2024-01-01", 1)] * 2), "1d", "test")
    plan = store.bars("1d", ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan


def test_legacy_and_exports(spark, tmp_path):
    (tmp_path / "HD.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-09-09,1,2,0.5,1.5,1.4,10\n2024-09-10,1,2,0.5,x,1.4,11.0\n")
    b = readers.legacy_csv(spark, str(tmp_path / "HD.csv"))
    assert [(r.ticker, r.close, r.volume) for r in b.orderBy("ts").collect()] == [("HD", 1.5, 10), ("HD", None, 11)]
    assert not readers.has_time_parts(b).first().has_time
    assert sinks.save_sqlite(b, str(tmp_path / "x.db")) == 2
    sinks.save_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "out"), escape=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().a == "'=1+1"
    (tmp_path / "list.txt").write_text("aapl, brk.b # mine\nAAPL msft\n")
    assert [r.ticker for r in readers.ticker_list(spark, str(tmp_path / "list.txt")).collect()] == ["AAPL", "BRK-B", "MSFT"]
    (tmp_path / "u.csv").write_text("Rank,COMPANY,Ticker\n1,Apple,AAPL\nx,Other,OTH\n3,,NO\n")
    assert readers.universe_csv(spark, str(tmp_path / "u.csv"), min_rows=2).count() == 2 and readers.universe_csv(spark, str(tmp_path / "u.csv")) is None


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert sinks.content_digest(a).first() == sinks.content_digest(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert sinks.content_digest(a).first() != sinks.content_digest(a.limit(1)).first()


def test_annotations(spark):
    log = spark.createDataFrame([], "id bigint, ticker string, note string, updated_at timestamp, client_timestamp timestamp")
    service = Service(None, None, log)
    service.annotate("aapl", " first ", datetime(2024, 1, 1))
    service.annotate("AAPL", "second", datetime(2024, 1, 2))
    assert [r.note for r in service.annotations().collect()] == ["second"] and [r.note for r in service.annotation_history("AAPL").collect()] == ["first", "second"]
    with pytest.raises(P.ValidationError):
        service.annotate("AAPL", "  ", None)
    server = spark.createDataFrame([("A", "s", datetime(2024, 1, 2))], "ticker string, note string, updated_at timestamp")
    pending = spark.createDataFrame([("A", "old", datetime(2024, 1, 1)), ("A", "new", datetime(2024, 1, 3)), ("B", "b", datetime(2024, 1, 1)), ("A", "same", datetime(2024, 1, 2))], "ticker string, note string, client_timestamp timestamp")
    assert {(r.note, r.outcome) for r in annotations.synced(server, pending).collect()} == {("old", "conflict"), ("new", "applied"), ("b", "applied"), ("same", "conflict")}
    assert {r.ticker: r.note for r in annotations.merged(server, pending).collect()} == {"A": "new", "B": "b"}


def test_service(spark):
    day = datetime(2024, 1, 1)
    rows = [(t, (day + timedelta(days=i)).isoformat(), 10 + i * k) for k, t in ((1, "AAA"), (2, "BBB")) for i in range(30)]
    u = spark.createDataFrame([(i, f"C{i}", f"T{i}") for i in range(1, 30)], "rank int, company string, ticker string")
    s = Service(bars(spark, rows), u, today=date(2024, 2, 1))
    p = s.prices("aaa,bbb", 30, columns="CLOSE")
    assert p["columns"] == [["close", "AAA"], ["close", "BBB"]] and len(p["data"]) == 30
    assert {r.ticker for r in s.metrics("AAA,BBB", "cc_vol", 30, min_days=10).collect()} == {"AAA", "BBB"}
    assert s.universe(10).count() == 10
    status, body, tag = s.tagged({"b": 1, "a": 2})
    assert body == '{"a":2,"b":1}' and s.tagged({"a": 2, "b": 1}, tag)[0] == 304
    for call in (lambda: s.metrics("AAA", "nope"), lambda: s.metrics("AAA", lookback_days=40, min_days=50), lambda: s.universe(5), lambda: s.prices("AAA", 10)):
        with pytest.raises(P.ValidationError):
            call()


def test_kpi(spark):
    rows = [(f"c{i}", date(2024, 1, 1), "s", float(i), float(i * i), int(i > 6)) for i in range(12)]
    panel = spark.createDataFrame(rows, "company string, date date, sector string, x double, y double, label int")
    out = kpi.health_scores(panel, ["x", "y"]).collect()
    best = max(out, key=lambda r: r.health_score)
    assert best.company == "c11" and best.health_score == pytest.approx(100)
    sup = {r.company: r.health_score for r in kpi.health_scores(panel, ["x", "y"], label="label", bootstrap=False).collect()}
    assert sup["c0"] > sup["c11"]
    one = panel.withColumn("label", F.lit(1))
    assert all(r.score is None or r.score != r.score for r in kpi.logit_scores(one, ["x", "y"]).collect())
    assert {r.score for r in kpi.fallback_scores(panel, ["x", "y"]).select("score").collect()} == {100 * 13 / 24}


def test_stream_upsert(spark, tmp_path):
    from quantide.streaming import bars as S

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    src = tmp_path / "in"
    schema = "ticker string, ts timestamp, close double"
    bars(spark, [("A", "2024-01-01", 1), ("A", "2024-01-02", 2)]).coalesce(1).write.parquet(str(src))
    store = readers.BarStore(spark, str(tmp_path / "store"))
    S.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), store, "1d", str(tmp_path / "q")).awaitTermination()
    bars(spark, [("A", "2024-01-02", 9), ("B", "2024-01-02", 3)]).coalesce(1).write.mode("append").parquet(str(src))
    S.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), store, "1d", str(tmp_path / "q")).awaitTermination()
    assert [(r.ticker, r.close) for r in store.bars("1d").orderBy("ticker", "ts").collect()] == [("A", 1.0), ("A", 9.0), ("B", 3.0)]


def _panel_rows(spark, n=60):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"c{k}", "2024-01-01", "ab"[k % 2], *(float(v) for v in rng.standard_normal(3) * (3, 1, 0.5)), int(k % 3 == 0)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "company string, date string, sector string, x double, y double, z double, label int")


def test_components_against_numpy(spark):
    """Scores of each sector against a decomposition of its rows."""
    import numpy as np
    import pandas as pd

    from quantide.operators import kpi

    rows, panel = _panel_rows(spark)
    got = {r.company: r for r in kpi.pca_scores(panel, ["x", "y", "z"]).collect()}
    for sector in "ab":
        own = [r for r in rows if r[2] == sector]
        m = np.array([r[3:6] for r in own])
        c = m - m.mean(axis=0)
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        ratio = s**2 / (s**2).sum()
        k = int(np.searchsorted(np.cumsum(ratio), 0.7)) + 1
        vt = vt[:k] * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
        raw = pd.Series(((c @ vt.T) * ratio[:k]).sum(axis=1))
        want = 100 * raw.clip(raw.quantile(0.02), raw.quantile(0.98)).rank(pct=True)
        back = (c @ vt.T) @ vt
        for r, score, contribution in zip(own, want, back, strict=True):
            assert abs(got[r[0]].score - score) < 1e-6 and abs(got[r[0]].contrib_x - contribution[0]) < 1e-9
    short = kpi.pca_scores(panel.where("company = 'c0'"), ["x", "y", "z"]).first()
    assert short.score is None


def test_scores_read_the_panel_few_times(spark, monkeypatch):
    """One pass for both stages' quantiles, one count for quantiles and ranks: the results of the single stages, from fewer tables."""
    from quantide.operators import kpi, order_stats

    names, made = ["x", "y", "z"], []
    panel = _panel_rows(spark)[1].drop("label")
    both = {r.company: r for r in kpi.winsorised_and_scaled(panel, names).collect()}
    for r in kpi.scaled(kpi.winsorised(panel, names), names).collect():
        assert tuple(both[r.company]) == tuple(r)
    blocks, tables = order_stats.value_blocks, kpi.written
    note = lambda f, at: lambda *a, **k: made.append(a[at]) or f(*a, **k)
    monkeypatch.setattr(kpi, "written", note(tables, 1))
    for module in (order_stats, kpi):
        monkeypatch.setattr(module, "value_blocks", note(blocks, 3))
    out = kpi.health_scores(panel, names)
    assert out.count() == 60 and sorted(t for t in made if t in ("quantiles", "raw", "ranks")) == ["quantiles"] * 3 + ["ranks", "raw"]
    assert "ranking" not in made and made.count("scores") == 1


def test_sectors_with_different_numbers_of_components(spark):
    """One sector needs one component, one two, one has none."""
    import numpy as np
    import pandas as pd

    from quantide.operators import kpi

    rng = np.random.default_rng(7)
    scale = {"one": (9, 0.1), "two": (1, 1)}
    rows = [(f"{s}{k}", s, *(float(v) for v in rng.standard_normal(2) * scale[s])) for s in scale for k in range(40)] + [("alone", None, 1.0, 2.0)]
    panel = spark.createDataFrame(rows, "company string, sector string, x double, y double")
    sizes = {r["_s"]: len(r.ratios) for r in kpi.components(panel, ["x", "y"]).collect()}
    assert sizes == {"one": 1, "two": 2}
    got = {r.company: r for r in kpi.pca_scores(panel, ["x", "y"], keep=["company", "sector"]).collect()}
    assert len(got) == len(rows) and got["alone"].score is None and got["alone"].contrib_x is None
    for r in kpi.components(panel, ["x", "y"]).collect():
        own = [x for x in rows if x[1] == r["_s"]]
        v, c = np.array(r.loadings), np.array([x[2:] for x in own]) - np.array(r.means)
        raw = pd.Series(((c @ v.T) * r.ratios).sum(axis=1))
        want = 100 * raw.clip(raw.quantile(0.02), raw.quantile(0.98)).rank(pct=True)
        for x, score, back in zip(own, want, c @ v.T @ v, strict=True):
            assert abs(got[x[0]].score - score) < 1e-9 and abs(got[x[0]].contrib_y - back[1]) < 1e-9


def test_logistic_models_against_plain_newton(spark):
    import numpy as np

    from quantide.operators import kpi

    rows, panel = _panel_rows(spark)
    fold = F.pmod(F.xxhash64("company"), F.lit(5)).cast("int")
    got = {(r["_s"], r.model): r.w for r in kpi.logit_models(panel.withColumn("_fold", fold), ["x", "y", "z"], "label", 5).collect()}
    folds = {r.company: r["_fold"] for r in panel.select("company", fold.alias("_fold")).collect()}
    assert set(got) == {(s, m) for s in "ab" for m in range(6)}
    for (sector, model), w in got.items():
        own = [r for r in rows if r[2] == sector and folds[r[0]] != model]
        a, y = np.array([[*r[3:6], 1.0] for r in own]), np.array([r[6] for r in own])
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        p = 1 / (1 + np.exp(-a @ np.array(w)))
        # at the optimum the penalised gradient is zero
        gradient = a.T @ (weight * (p - y)) + np.array([1, 1, 1, 0]) * np.array(w)
        assert np.abs(gradient).max() < 1e-6


def test_percent_ranks_by_blocks(spark):
    from quantide.operators import kpi

    rows = [(f"c{k}", "ab"[k % 7 == 0], float(k * k % 37) if k % 11 else None) for k in range(400)]
    panel = spark.createDataFrame(rows, "company string, sector string, v double")
    got = {r.company: r.p for r in kpi.percent_ranked(panel, "v", "p").collect()}
    for company, sector, v in rows:
        own = [x if x is not None else -1.0 for _, s, x in rows if s == sector]
        value = -1.0 if v is None else v
        below, same = sum(x < value for x in own), sum(x == value for x in own)
        assert abs(got[company] - 100 * (below + (same + 1) / 2) / len(own)) < 1e-9


def test_late_errors_stay_with_their_instrument(spark):
    """A source whose table fails only when it is read: the batch is asked for one by one."""
    bars = spark.range(6).selectExpr("element_at(array('A', 'B', 'C'), cast(id % 3 + 1 as int)) AS ticker", "timestamp'2024-01-02' AS ts", "1.0D AS close")

    class Late:
        asked: list = []

        def get_prices(self, tickers, start, end, interval):
            self.asked.append(tickers)
            return bars.where(F.col("ticker").isin(*tickers)).withColumn("close", F.when(F.col("ticker") == "B", F.raise_error(F.lit("gone")).cast("double")).otherwise(F.col("close")))

    found = fetching.fetch_many(Late(), ["A", "B", "C"], date(2024, 1, 1), date(2024, 1, 3), "1d")
    assert {r.ticker for r in found.bars.collect()} == {"A", "C"} and [t for t, _ in found.failures] == ["B"]
    assert Late.asked == [["A", "B", "C"], ["A"], ["B"], ["C"]]


def test_tasks_are_sent_their_own_names(spark):
    """What every task is sent doesn't hold the names of the others, and the number of tasks has a bound."""
    from pyspark import cloudpickle

    from quantide.sources import quotes

    class One:
        def quotes(self, tickers, start, end, interval):
            return [(t, datetime(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, None, 1) for t in tickers]

    asking = quotes.Asking(One(), date(2024, 1, 1), date(2024, 1, 3), "1d")
    sizes = []
    for n in (50, 50_000):
        names = [f"name-{k}" for k in range(n)]
        source = quotes._data_source(asking, [names[a : a + 10] for a in range(0, n, 10)], "sizes")({})
        reader = source.reader(None)
        sizes.append(len(cloudpickle.dumps((reader, source))))
        parts = reader.partitions()
        assert len(parts) <= 1000 and [t for p in parts for b in p.batches for t in b] == names
    assert sizes[1] < sizes[0] + 100
    scan = quotes.quote_scan(spark, asking, [f"n{k}" for k in range(1050)], batch=1)
    assert sorted(r.ticker for r in scan.select("ticker").collect()) == sorted(f"n{k}" for k in range(1050))
    assert scan.rdd.getNumPartitions() == 525


def test_quotes_lie_in_files_of_many_instruments(spark):
    from quantide.plans import durability_queries as D

    rows = spark.range(2000).selectExpr("concat('t/', id % 1000) AS ticker", "timestamp'2024-01-02' + make_interval(0, 0, 0, cast(id div 1000 as int)) AS ts", "1.0D AS open", "2.0D AS high", "1.0D AS low", "id * 0.1D AS close", "id AS volume")
    folders = []
    with pytest.MonkeyPatch.context() as m:
        folder = D._folder
        m.setattr(D, "_folder", lambda s, name: folders.append(folder(s, name)) or folders[-1])
        got, asked = D._quotes(spark, None, rows, [f"t/{k}" for k in range(1000)])
    names = ("ticker", "ts", "close", "volume")
    assert sorted(got.bars.select(*names).collect()) == sorted(rows.select(*names).collect()) and got.failures == []
    assert asked.count() == 1000
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folders[0]).select("path")
    assert files.count() == 7


def test_two_features_are_prepared_alone(spark):
    """kpi_pca_scores prepares the features it scores, and no others."""
    import os

    from quantide.plans import kpi_queries as Q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    assert Q._ready_two(spark, sf).columns == ["company", "date", "sector", "n_orders", "revenue"]
