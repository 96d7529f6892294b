"""Queries through stores, files, payloads, the service and the registries."""

from __future__ import annotations

import json
import sqlite3
import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from quantide import params as P
from quantide.operators import annotations, bars as B, calendar, ingest, metrics, returns, universe, validate
from quantide.plans import inputs as I
from quantide.plans.metric_queries import _BAR_COLUMNS, _CC, _ohlc_sql, _stamp, rounded
from quantide.service import Service
from quantide.sources import fetching, readers, sinks
from quantide.streaming import bars as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = date(2024, 1, 31)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _folder(s, name):
    return S.state_folder(s, f"{name}-{uuid.uuid4().hex}")


def _store(s, d, interval="1d", **options):
    store = readers.BarStore(s, _folder(s, "store"))
    sinks.save_bars(store, I.dense(s, d), interval, "test", **options)
    return store


class TableSource:
    """Serves a table of bars; instruments named in ``broken`` raise, alone or in a batch."""

    def __init__(self, bars, broken=()):
        self.bars, self.broken = bars, set(broken)

    def get_prices(self, tickers, start, end, interval):
        if self.broken & set(tickers):
            raise ConnectionError("unreachable")
        return self.bars.where(F.col("ticker").isin(*tickers) & (F.to_date("ts") >= F.lit(start)) & (F.to_date("ts") < F.lit(end)))


_ALL = f"WITH {I.DENSE} SELECT {_BAR_COLUMNS} FROM bars"
_COLS = ("ticker", "ts", "open", "high", "low", "close", "volume")

# -- stores and files -------------------------------------------------------------------
query("store_round_trip", _ALL)(lambda s, d: _store(s, d).bars("1d").select(*_COLS))
query("store_pruned", f"{_ALL} WHERE ticker IN ('click', 'view')")(lambda s, d: _store(s, d).bars("1d", ["click", "view", "nothing"]).select(*_COLS))
query("store_load_one", f"{_ALL} WHERE ticker = 'click'")(lambda s, d: _store(s, d).load("click").select(*_COLS))
query("store_tickers", f"WITH {I.DENSE} SELECT DISTINCT ticker FROM bars")(lambda s, d: _store(s, d).stored_tickers("1d"))
query("store_manifest", f"WITH {I.DENSE} SELECT ticker, '1d' AS interval, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS \"end\", count(*) AS rows, 'test' AS source, 2 AS version FROM bars GROUP BY ticker")(
    lambda s, d: _store(s, d).manifests().drop("updated_at")
)


@query("store_replaces_touched", f"WITH {I.DENSE} SELECT {_BAR_COLUMNS} FROM bars WHERE ticker <> 'click' OR ts >= TIMESTAMP '2024-01-15'")
def _replaced(s, d):
    """Saving again replaces the instruments present and leaves the others."""
    store = _store(s, d)
    sinks.save_bars(store, I.dense(s, d).where("ticker = 'click' and ts >= timestamp_ntz'2024-01-15'"), "1d", "test")
    return store.bars("1d").select(*_COLS)


_JAN = (date(2024, 1, 1), TODAY)


@query("store_refuses_gaps", "SELECT 'refused' AS first, 'saved' AS second")
def _gapped(s, d):
    """A missing session is refused, and saved where gaps of that kind are allowed (by leaving sessions out)."""
    store, sessions = readers.BarStore(s, _folder(s, "store")), calendar.sessions(s, *_JAN)
    holed = I.dense(s, d).where("not (ticker = 'click' and to_date(ts) = date'2024-01-10')")
    try:
        sinks.save_bars(store, holed, "1d", "test", sessions=sessions)
        first = "saved"
    except P.ValidationError:
        first = "refused"
    sinks.save_bars(store, holed, "1d", "test", sessions=sessions.where("session <> date'2024-01-10'"))
    return s.createDataFrame([(first, "saved" if store.bars("1d").count() == holed.count() else "lost")], "first string, second string")


def _legacy_folder(s, d):
    path = _folder(s, "legacy")
    rows = I.dense(s, d).select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    _ticker_files(s, rows, path)
    return f"{path}/*.csv"


def _ticker_files(s, rows, path):
    """One file per instrument, named after it."""
    for r in rows.select("ticker").distinct().orderBy("ticker").collect():
        sinks.save_csv(rows.where(F.col("ticker") == r.ticker).drop("ticker"), f"{path}/{r.ticker}", one_file=True)
    fs = s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsparkSession.sessionState().newHadoopConf())
    for part in fs.globStatus(s._jvm.org.apache.hadoop.fs.Path(f"{path}/*/part-*.csv")):
        fs.rename(part.getPath(), s._jvm.org.apache.hadoop.fs.Path(f"{path}/{part.getPath().getParent().getName()}.csv"))


query("legacy_csv", _ALL)(lambda s, d: readers.legacy_csv(s, _legacy_folder(s, d)).select(*_COLS))


@query("convert_legacy", f"WITH {I.DENSE} SELECT ticker, 'repair' AS source, count(*) AS rows FROM bars GROUP BY ticker")
def _convert(s, d):
    store = readers.BarStore(s, _folder(s, "store"))
    sinks.convert_legacy(store, _legacy_folder(s, d))
    return store.manifests().select("ticker", "source", "rows")


@query("convert_legacy_intraday", f"WITH {I.HOURLY} SELECT {_BAR_COLUMNS} FROM bars WHERE ticker IN ('click', 'view')")
def _convert_intraday(s, d):
    """Of files with and without times only the former are intraday bars; a folder without any is refused."""
    store, path = readers.BarStore(s, _folder(s, "store")), _folder(s, "legacy")
    hourly, daily = B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type").where("ticker in ('click', 'view')"), I.dense(s, d).where("ticker not in ('click', 'view')")
    both = hourly.select(*_COLS, F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")).unionByName(daily.select(*_COLS, F.date_format("ts", "yyyy-MM-dd").alias("at")))
    _ticker_files(s, both.select("ticker", F.col("at").alias("Datetime"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume")), path)
    sinks.convert_legacy(store, f"{path}/*.csv", "1h")
    try:
        sinks.convert_legacy(store, _legacy_folder(s, d), "1h")
    except P.ValidationError:
        return store.bars("1h").select(*_COLS)
    raise AssertionError("bars without times were taken")


@query("convert_legacy_deleted", f"WITH {I.DENSE} SELECT {_BAR_COLUMNS}, 0 AS files FROM bars")
def _convert_deleted(s, d):
    """The files of what was stored are gone afterwards."""
    store, path = readers.BarStore(s, _folder(s, "store")), _legacy_folder(s, d)
    sinks.convert_legacy(store, path, delete=True)
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    left = where.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return store.bars("1d").select(*_COLS, F.lit(len(left)).alias("files"))


@query("request_windows", "WITH x AS (SELECT event_type AS ticker, min(ts) AS a, least(max(ts), TIMESTAMP '2024-01-20') AS b FROM events GROUP BY event_type) SELECT ticker, '60m' AS interval, greatest(1, ceil(floor(epoch(b) - epoch(a)) / 86400))::INT || 'd' AS range, round(epoch(b) - epoch(a), 3) AS seconds FROM x")
def _request_windows(s, d):
    """What a quote service is asked for, for each instrument's first to last tick."""
    spans = I.read(s, d, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()  # a row for each instrument
    rows = [(r.ticker, readers.request_window("1h", r.a, r.b, datetime(2024, 1, 20)), readers.request_window("1d", r.a, r.b, datetime(2024, 1, 20))) for r in spans]
    return s.createDataFrame([(t, hours["interval"], hours["range"], (days["end"] - days["start"]).total_seconds()) for t, hours, days in rows], "ticker string, interval string, range string, seconds double").withColumn("seconds", F.round("seconds", 3))


@query("universe_csv", f"WITH {I.COMPANIES} SELECT rank, company, trim(ticker) AS ticker FROM companies")
def _universe_csv(s, d):
    path = _folder(s, "universe")
    sinks.save_csv(I.companies(s, d).toDF("Rank", "COMPANY", " ticker"), path)
    rows = s.read.option("header", True).csv(path).count()
    assert readers.universe_csv(s, path, min_rows=rows + 1) is None
    assert readers.universe_csv(s, path, max_age_days=1, modified=datetime(2024, 1, 1), now=datetime(2024, 1, 9)) is None
    return readers.universe_csv(s, path, min_rows=rows)


query("universe_fallback", "SELECT * FROM (VALUES (1, 'Apple', 'AAPL'), (2, 'Microsoft', 'MSFT'), (3, 'Alphabet', 'GOOGL')) v(rank, company, ticker)")(lambda s, d: universe.or_fallback(I.companies(s, d).limit(0), 3))
query("universe_no_fallback", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM companies ORDER BY rank LIMIT 3")(lambda s, d: universe.or_fallback(I.companies(s, d), 3))


@query("ticker_list", "SELECT min(s_suppkey) - 1 AS k, 'N-' || s_nationkey AS ticker FROM supplier GROUP BY s_nationkey")
def _ticker_list(s, d):
    path = _folder(s, "tickers")
    names = I.read(s, d, "supplier").orderBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_nationkey"))), lambda x: F.concat(F.lit("n."), x["s_nationkey"].cast("string"))), ", ").alias("v"))
    names.select(F.concat(F.lit("# a list\n"), "v", F.lit(" # x, y\n"))).write.text(path)
    first = I.read(s, d, "supplier").select(F.concat(F.lit("N-"), F.col("s_nationkey").cast("string")).alias("ticker"), "s_suppkey").groupBy("ticker").agg((F.min("s_suppkey") - 1).alias("k"))
    return readers.ticker_list(s, path).join(first, "ticker").select("k", "ticker")


@query("sqlite_export", f"WITH {I.DENSE}, {I.GRID} {_CC.format(ppy=252)}")
def _sqlite(s, d):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        sinks.save_sqlite(metrics.compute("cc_vol", I.dense(s, d)), f"{folder}/x.db")
        with sqlite3.connect(f"{folder}/x.db") as con:
            rows = con.execute("select ticker, cc_vol from volatility").fetchall()
    return s.createDataFrame(rows, "ticker string, cc_vol double")


@query("csv_export_escaped", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN chr(39) || '=' || p_name ELSE p_name END AS name FROM part")
def _csv(s, d):
    path = _folder(s, "csv")
    sinks.save_csv(I.read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name")).alias("name")), path, escape=True)
    return s.read.option("header", True).csv(path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "name")


@query("failures_csv", "SELECT '1d' AS interval, s_name AS ticker, 'missing_cache' AS reason, 2::BIGINT AS n FROM supplier")
def _failures(s, d):
    path = _folder(s, "failures")
    rows = ingest.missing_report(I.read(s, d, "supplier").select(F.col("s_name").alias("ticker")), s.createDataFrame([], "ticker string, interval string, version int"), ["1d"])
    for _ in range(2):
        sinks.append_failures(rows, path)
    return s.read.option("header", True).csv(path).groupBy("interval", "ticker", "reason").agg(F.count(F.lit(1)).alias("n"))


query("records_json", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")(lambda s, d: I.read(s, d, "region").select("r_regionkey", "r_name").select("r_regionkey", sinks.records_json(I.read(s, d, "region").select("r_regionkey", "r_name")).alias("j")))
query("sha256_tag", """SELECT sha256('[' || string_agg('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}', ',' ORDER BY r_regionkey) || ']') AS tag FROM region""")(
    lambda s, d: s.createDataFrame([(sinks.canonical([r.asDict() for r in I.read(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()])[1],)], "tag string")
)
query("synthetic_bars", "SELECT 'B' AS ticker, 50::BIGINT AS n, TRUE AS sound, '2020-02-19' AS last UNION ALL SELECT 'A', 50, TRUE, '2020-02-19'")(
    lambda s, d: readers.synthetic_bars(s, 50, ["A", "B"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))).alias("sound"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))
)

# -- fetching -----------------------------------------------------------------------------


def _fetched(s, d, broken):
    names = ["click", "view", "purchase", "error", "signup", "nothing"]
    return fetching.fetch_many(TableSource(I.dense(s, d), broken), names, date(2024, 1, 1), date(2024, 2, 1), "1d", batch=4)


query("fetch_batches", f"{_ALL} WHERE ticker <> 'view'")(lambda s, d: _fetched(s, d, ["view"]).bars.select(*_COLS))
query("fetch_failures", "SELECT * FROM (VALUES ('1d', 'view', 'ConnectionError: unreachable'), ('1d', 'nothing', 'no data')) v(interval, ticker, reason)")(lambda s, d: _fetched(s, d, ["view"]).failure_rows(s, "1d").drop("timestamp"))


@query("fetch_retries", f"WITH {I.DENSE} SELECT ticker, count(*) AS n, 2 AS waits FROM bars WHERE ticker = 'click' GROUP BY ticker")
def _retries(s, d):
    waits: list[float] = []
    source = TableSource(I.dense(s, d), ["click"])

    def sleep(seconds):
        waits.append(seconds)
        source.broken = set() if len(waits) == 2 else source.broken

    got = fetching.RetryingSource(source, sleep=sleep).get_prices(["click"], date(2024, 1, 1), date(2024, 2, 1), "1d")
    return got.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn("waits", F.lit(len(waits)))


@query("refresh_store", _ALL)
def _refresh(s, d):
    """A store of the first days is brought up to date; the broken instrument keeps what it had and is got by a later refresh."""
    store = readers.BarStore(s, _folder(s, "store"))
    sinks.save_bars(store, I.dense(s, d).where("ts < timestamp_ntz'2024-01-12'"), "1d", "test")
    names = ["click", "view", "purchase", "error", "signup"]
    first = fetching.refresh(store, TableSource(I.dense(s, d), ["view"]), names, "1d", TODAY)
    assert [t for t, _ in first.failures] == ["view"]
    fetching.refresh(store, TableSource(I.dense(s, d)), names, "1d", TODAY)
    return store.bars("1d").select(*_COLS)


@query("backfill_intervals", f"WITH {I.DENSE} SELECT i.interval, ticker, count(*) AS n FROM bars CROSS JOIN (VALUES ('1d'), ('1wk')) i(interval) GROUP BY ALL")
def _backfill(s, d):
    store = readers.BarStore(s, _folder(s, "store"))
    fetching.backfill(store, TableSource(I.dense(s, d)), ["click", "view", "purchase", "error", "signup"], ["1d", "1wk"], TODAY)
    return store.bars("1d").withColumn("interval", F.lit("1d")).unionByName(store.bars("1wk").withColumn("interval", F.lit("1wk"))).groupBy("interval", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query("history_modes", f"WITH {I.DENSE} SELECT m.mode, ticker, count(*) AS n FROM bars CROSS JOIN (VALUES ('batch'), ('async'), ('cache')) m(mode) WHERE ts >= TIMESTAMP '2024-01-11' AND ticker IN ('click', 'view') GROUP BY ALL")
def _modes(s, d):
    store = _store(s, d)
    found = [fetching.history(store, TableSource(I.dense(s, d)), ["click", "view"], 10, "1d", TODAY, m).withColumn("mode", F.lit(m)).select("mode", "ticker", "ts") for m in fetching.MODES]
    try:
        fetching.history(store, None, ["click"], 10, "1d", TODAY, "other")
        raise AssertionError("an unknown mode was taken")
    except P.ValidationError:
        pass
    return found[0].union(found[1]).union(found[2]).groupBy("mode", "ticker").agg(F.count(F.lit(1)).alias("n"))


query("drop_null_strict", f"WITH {I.PANEL} SELECT company, strftime(date, '%Y-%m-%d') AS date FROM panel WHERE largest IS NOT NULL AND balance IS NOT NULL")(lambda s, d: ingest.drop_null_prices(I.panel(s, d)).select("company", "date"))
query("drop_null_preferred", f"WITH {I.PANEL} SELECT company, strftime(date, '%Y-%m-%d') AS date FROM panel WHERE balance IS NOT NULL")(lambda s, d: ingest.drop_null_prices(I.panel(s, d).withColumnRenamed("balance", "close"), strict=False).select("company", "date"))
query("fetch_plan_forced", f"WITH {I.DENSE} SELECT DISTINCT ticker, strftime(DATE '2024-01-31' - 12775, '%Y-%m-%d') AS fetch_start, TRUE AS needs_fetch FROM bars")(lambda s, d: ingest.fetch_plan(I.dense(s, d).select("ticker"), I.dense(s, d), F.lit("1d"), F.lit(TODAY), force=True).drop("cached_max_ts"))
query("violations_order_and_gaps", f"WITH {I.DENSE} SELECT DISTINCT ticker, 'unsorted' AS rule FROM bars UNION ALL SELECT DISTINCT ticker, 'gap 2024-01-10' FROM bars WHERE ticker = 'click'")(
    lambda s, d: validate.violations(I.dense(s, d).withColumn("o", -F.unix_timestamp(F.col("ts").cast("timestamp"))), ingest.manifest(I.dense(s, d), "1d", "x"), "o").union(
        validate.gaps(I.holed(s, d), calendar.sessions(s, *_JAN), "1d").select("ticker", F.concat(F.lit("gap "), "detail"))
    )
)

# -- metrics and rankings -------------------------------------------------------------------
_TITLED = ", ".join(f'{k} AS "{metrics.DISPLAY_NAMES[k]}"' for k in ("cc_vol", *metrics.OHLC[:4]))
query("metric_table_titles", f"WITH {I.EVENT_UNIVERSE}, o AS ({_ohlc_sql(I.DENSE, 0)}), c AS (WITH {I.DENSE}, {I.GRID} {_CC.format(ppy=252)}) SELECT rank, company, univ.ticker, {_TITLED} FROM univ JOIN o USING (ticker) JOIN c USING (ticker)")(
    lambda s, d: universe.metric_table("cc_vol", I.dense(s, d), I.event_universe(s, d)).select("rank", "company", "ticker", *[metrics.DISPLAY_NAMES[k] for k in ("cc_vol", *metrics.OHLC[:4])])
)
_CHECKS = ("cc_vol", "parkinson_vol", "gk_vol", "rs_vol", "yz_vol")
query("metrics_cross_checked", f"WITH o AS ({_ohlc_sql(I.DENSE, 0)}), c AS (WITH {I.DENSE}, {I.GRID} {_CC.format(ppy=252)}) SELECT ticker, {', '.join(_CHECKS)} FROM o JOIN c USING (ticker)")(lambda s, d: metrics.cross_checked(I.dense(s, d)))
query("metrics_disagreements", "SELECT '' AS ticker, '' AS metric WHERE FALSE")(lambda s, d: metrics.disagreements(I.dense(s, d)).select("ticker", "metric"))
_RANKED = f"ranked AS (SELECT * FROM ({_CC.format(ppy=252)}) WHERE cc_vol IS NOT NULL)"
query("top_series", f"WITH {I.SPARSE}, {I.GRID}, {_RANKED} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\" FROM bars WHERE ticker IN (SELECT ticker FROM ranked ORDER BY cc_vol DESC, ticker LIMIT 5)")(
    lambda s, d: universe.top_series(metrics.compute("cc_vol", I.sparse(s, d)), I.sparse(s, d), 5, "cc_vol").select("ticker", "ts", "close")
)
query("highlighted", f"WITH {I.SPARSE}, {I.GRID}, {_RANKED} SELECT ticker, cc_vol, row_number() OVER (ORDER BY cc_vol DESC, ticker) <= 10 AS highlight FROM ranked")(
    lambda s, d: universe.highlighted(metrics.compute("cc_vol", I.sparse(s, d)).where("cc_vol is not null"), "cc_vol")
)
query("default_selection", f"WITH {I.DENSE}, {I.GRID}, {_RANKED} SELECT ticker FROM ranked ORDER BY cc_vol DESC, ticker LIMIT 2")(lambda s, d: universe.default_selection(metrics.compute("cc_vol", I.dense(s, d)), "cc_vol", 2))
query("inferred_interval", f"WITH {I.SPARSE}, x AS (SELECT ticker, epoch(ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts)) / 60 AS m FROM bars), n AS (SELECT ticker, m, count(*) AS n FROM x WHERE m > 0 GROUP BY ALL) SELECT ticker, round(arg_max(m, (n, -m)), 6) AS minutes, round(max(n) / sum(n), 6) AS share FROM n GROUP BY ticker")(lambda s, d: validate.inferred_interval(I.sparse(s, d)))


@query("metric_plugin", f"WITH {I.DENSE} SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker")
def _plugin(s, d):
    metrics.register_metric("n_bars", lambda bars: bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars")))
    try:
        return metrics.compute("n_bars", I.dense(s, d))
    finally:
        del metrics.METRICS["n_bars"]


query("metric_choices", "SELECT unnest(['cc_vol', 'ewma_vol', 'gk_vol', 'mad_vol', 'max_drawdown', 'parkinson_vol', 'rs_vol', 'sharpe_ratio', 'sortino', 'var', 'yz_vol']) AS metric")(lambda s, d: s.createDataFrame([(m,) for m in metrics.metric_choices()], "metric string"))
query("metric_display_names", "SELECT * FROM (VALUES ('yz_vol', 'Yang-Zhang Volatility'), ('my_own_metric', 'My Own Metric')) v(metric, title)")(lambda s, d: s.createDataFrame([(m, metrics.display_name(m)) for m in ("yz_vol", "my_own_metric")], "metric string, title string"))

# -- service ----------------------------------------------------------------------------------


def _service(s, d):
    u = I.companies(s, d)
    return Service(I.dense(s, d), u, I.annotation_log(s, d).select("id", "ticker", "note", "updated_at", F.col("updated_at").alias("client_timestamp")), TODAY)


query("service_universe", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM clean ORDER BY rank, ticker LIMIT 10")(lambda s, d: _service(s, d).universe("10"))
query("service_metrics", f"SELECT ticker, gk_vol FROM ({_ohlc_sql(I.DENSE, 10)}) WHERE ticker IN ('click', 'view')")(lambda s, d: Service(I.dense(s, d).withColumn("ticker", F.upper("ticker")), I.companies(s, d), None, TODAY).metrics("click,VIEW", " GK_vol ", 252, "1d", 10).withColumn("ticker", F.lower("ticker")))


@query("service_prices", f"WITH {I.DENSE} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\" FROM bars WHERE ticker IN ('click', 'view')")
def _prices(s, d):
    payload = Service(I.dense(s, d).withColumn("ticker", F.upper("ticker")), I.companies(s, d), None, TODAY).prices("click,view", 252, "1d", "CLOSE")
    rows = [(t.lower(), at, float(v)) for at, values in zip(payload["index"], payload["data"], strict=True) for (_, t), v in zip(payload["columns"], values, strict=True) if v is not None]
    return s.createDataFrame(rows, "ticker string, at string, close double").select("ticker", F.to_timestamp("at").alias("ts"), "close")


@query("service_tags", "SELECT 200 AS first, 304 AS second, 0 AS body")
def _tags(s, d):
    service = _service(s, d)
    payload = json.loads(json.dumps([r.asDict() for r in service.universe(10).collect()]))
    first, _, tag = service.tagged(payload)
    second, body, _ = service.tagged(payload, tag)
    return s.createDataFrame([(first, second, len(body))], "first int, second int, body int")


_LAST = "(SELECT max(id) FROM log)"
query("annotation_upsert", f"WITH {I.LOG}, new AS (SELECT *, row_number() OVER (ORDER BY conv_id * 100 + turn) AS k FROM conversations WHERE role = 'user') SELECT {_LAST} + k AS id, 'N' || (conv_id * 100 + turn) AS ticker FROM new")(
    lambda s, d: annotations.upserted(
        I.annotation_log(s, d).select("id", "ticker", "note", "updated_at"),
        I.read(s, d, "conversations").where("role = 'user'").select(F.concat(F.lit("N"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("ticker"), F.col("text").alias("note"), F.timestamp_seconds(1_700_000_000 + 3600 * (F.col("conv_id") * 100 + F.col("turn"))).alias("client_timestamp")),
    ).where("ticker like 'N%'").select("id", "ticker")
)
query("service_annotations", f"WITH {I.LOG} SELECT 'T1' AS ticker, 'hello' AS note, max(id) + 1 AS id FROM log")(lambda s, d: _annotated(s, d))


def _annotated(s, d):
    service = _service(s, d)
    service.annotate("T1", "  hello ", datetime(2030, 1, 1))
    return service.annotations().where("note = 'hello'").select("ticker", "note", "id")


query("service_history", f"WITH {I.LOG} SELECT id, ticker, note FROM log WHERE ticker = 'T2' ORDER BY id DESC LIMIT 3")(lambda s, d: _service(s, d).annotation_history("t2", 3).select("id", "ticker", "note"))
_GOOD = [("tickers", "a, b-c ,A"), ("interval", " 15M "), ("metric", "CC_vol"), ("format", "JSON"), ("columns", "Close,close, Open"), ("int", "12")]


@query("parameters", "SELECT * FROM (VALUES ('tickers', 'A|B-C|A'), ('interval', '15m'), ('metric', 'cc_vol'), ('format', 'json'), ('columns', 'Close|Open'), ('int', '12'), ('bad', 'validation_error')) v(name, value)")
def _parameters(s, d):
    checks = {"tickers": P.valid_tickers, "interval": P.valid_interval, "metric": P.valid_metric, "format": P.valid_format, "columns": P.valid_columns, "int": lambda x: P.valid_int(x, 0, 20)}
    rows = [(k, "|".join(v) if isinstance(v := checks[k](text), list) else str(v)) for k, text in _GOOD]
    bad = [("tickers", "a b"), ("interval", "x"), ("metric", "a b"), ("format", "xml"), ("columns", "a;b"), ("int", "21")]
    codes = set()
    for k, text in bad:
        try:
            checks[k](text)
            codes.add("taken")
        except P.ValidationError as error:
            codes.add(error.describe()["code"])
    return s.createDataFrame([*rows, ("bad", "|".join(sorted(codes)))], "name string, value string")


# -- streams ------------------------------------------------------------------------------------


def _ticks(s, d):
    schema = ", ".join(f"{c} {t}" for c, t in I.read(s, d, "events").dtypes)
    return S.tick_stream(s, f"{d}/events.parque[t]", schema).withColumnRenamed("event_type", "ticker")


@query("stream_upsert", _ALL)
def _upsert(s, d):
    """A stream's bars merged into a store that held other values."""
    store = readers.BarStore(s, _folder(s, "store"))
    sinks.save_bars(store, I.dense(s, d).withColumn("close", F.lit(-1.0)), "1d", "test", validate=False)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(_folder(s, "checkpoints"))
    S.upsert_stream(S.streaming_bars(_ticks(s, d)), store, "1d", _folder(s, "stream")).awaitTermination()
    return store.bars("1d").select(*_COLS)


@query("stream_deduplicated", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def _dedup(s, d):
    rows = S.deduplicated(_ticks(s, d), ["user_id", "ticker"], "400 days").select("user_id", "ticker")
    return S.run_to_table(rows, f"dedup_{uuid.uuid4().hex}", _folder(s, "stream"), "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


query("returns_daily_grid", f"WITH {I.DENSE}, {I.GRID} SELECT {_stamp('ts', 'date')}, ticker, round(r, 6) AS daily_return FROM rets WHERE r IS NOT NULL")(lambda s, d: returns.daily_returns(I.dense(s, d)))
query("hourly_bars_to_store", f"WITH {I.HOURLY} SELECT {_BAR_COLUMNS} FROM bars")(lambda s, d: _hourly(s, d))


def _hourly(s, d):
    store = readers.BarStore(s, _folder(s, "store"))
    sinks.save_bars(store, B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type"), "1h", "test")
    return store.bars("1h").select(*_COLS)
