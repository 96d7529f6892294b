"""Sanitation, ingest, universe, calendar, validation, annotations and functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quantide.functions import text as T
from quantide.operators import annotations, bars as B, calendar, ingest, sanitize, universe, validate
from quantide.plans import inputs as I
from quantide.plans.metric_queries import _stamp, rounded
from quantide.sources import readers, sinks

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


# -- sanitation ---------------------------------------------------------------------

def _with_copies(s, d):
    rows = I.sparse(s, d)
    return rows.unionByName(rows.where("ticker in ('1', '2', '3')").withColumn("ticker", F.concat(F.lit("0copy"), "ticker"))).unionByName(rows.where("ticker in ('1', '2')").withColumn("ticker", F.concat(F.lit("copy"), "ticker")))


_COPIES = I.SPARSE.replace("bars AS (", "bars0 AS (", 1) + """, bars AS (
  SELECT * FROM bars0 UNION ALL SELECT * REPLACE ('0copy' || ticker AS ticker) FROM bars0 WHERE ticker IN ('1', '2', '3')
  UNION ALL SELECT * REPLACE ('copy' || ticker AS ticker) FROM bars0 WHERE ticker IN ('1', '2'))"""


def _tails_sql(n: int) -> str:
    return f"""{I.GRID}, d AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS k FROM (SELECT DISTINCT ts FROM bars)),
f AS (SELECT ticker, ts, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts) AS px FROM grid JOIN d USING (ts) WHERE k <= {n}),
b AS (SELECT ticker, ts, first_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS px FROM f),
tails AS (SELECT ticker, list(px ORDER BY ts) AS tail FROM b GROUP BY ticker HAVING count(px) > 0)"""


def _status_sql(least: int) -> str:
    return f"""WITH {_COPIES}, {_tails_sql(60)}, n AS (SELECT ticker, count("close") AS n FROM bars GROUP BY ticker),
j AS (SELECT n.ticker, n < {least} AS short, tail FROM n LEFT JOIN tails ON tails.ticker = n.ticker)
SELECT ticker, CASE WHEN short THEN 'short' WHEN tail IS NULL THEN 'empty' WHEN row_number() OVER (PARTITION BY short, tail ORDER BY ticker) = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM j"""


query("sanitize_status", _status_sql(26))(lambda s, d: sanitize.sanitise(_with_copies(s, d), 26))
query("sanitize_short", f"SELECT ticker FROM ({_status_sql(27)}) WHERE status = 'short'")(lambda s, d: sanitize.sanitise(_with_copies(s, d), 27).where("status = 'short'").select("ticker"))
query("sanitize_duplicates", f"SELECT ticker FROM ({_status_sql(5)}) WHERE status = 'duplicate'")(lambda s, d: sanitize.sanitise(_with_copies(s, d), 5).where("status = 'duplicate'").select("ticker"))
query("drop_summary", f"SELECT status, count(*) AS n FROM ({_status_sql(26)}) WHERE status <> 'kept' GROUP BY status")(lambda s, d: sanitize.drop_summary(sanitize.sanitise(_with_copies(s, d), 26)))
query("kept_bars", f"WITH {_COPIES} SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT ticker FROM ({_status_sql(26)}) WHERE status = 'kept') GROUP BY ticker")(
    lambda s, d: sanitize.kept_bars(_with_copies(s, d), sanitize.sanitise(_with_copies(s, d), 26)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
)
query("fingerprint_clusters", f"WITH {_COPIES}, {_tails_sql(10)} SELECT array_to_string(list(ticker ORDER BY ticker), ',') AS tickers, count(*) AS n FROM tails GROUP BY tail HAVING count(*) >= 3")(
    lambda s, d: sanitize.suspect_clusters(_with_copies(s, d), 40).select(F.array_join("tickers", ",").alias("tickers"), "n")
)
query("recent_history", f"WITH {I.SPARSE} SELECT ticker FROM bars WHERE ts > TIMESTAMP '2024-01-25' AND ts <= TIMESTAMP '2024-01-30' GROUP BY ticker HAVING count(*) >= 5")(
    lambda s, d: sanitize.recent_history(I.sparse(s, d), F.lit(date(2024, 1, 30)), 5, 5)
)
query("grid_tail", f"WITH {I.SPARSE} SELECT ticker, count(*) AS n FROM bars WHERE ts IN (SELECT DISTINCT ts FROM bars ORDER BY ts DESC LIMIT 7) GROUP BY ticker")(
    lambda s, d: sanitize.rolling_tail(I.sparse(s, d), 7).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
)

# -- ingest -------------------------------------------------------------------------


def _old_new(s, d):
    """All events: those before 20 January as stored bars, and those from 10 January on, at twice the price, as new ones."""
    e = I.read(s, d, "events")
    old = B.from_ticks(e.where("ts < timestamp_ntz'2024-01-20'"), B.day(), "user_id")
    return old, B.from_ticks(e.where("ts >= timestamp_ntz'2024-01-10'").withColumn("value", 2 * F.col("value")), B.day(), "user_id")


_OLD = I.SPARSE.replace("bars AS", "old AS").replace("value > 0", "value > 0 AND ts < TIMESTAMP '2024-01-20'")
_NEW = I.SPARSE.replace("bars AS", "new AS").replace("FROM events", "FROM (SELECT * REPLACE (2 * value AS value) FROM events)").replace("value > 0", "value > 0 AND ts >= TIMESTAMP '2024-01-10'")
_MERGED = f"WITH {_OLD}, {_NEW}, merged AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE (ticker, ts) NOT IN (SELECT (ticker, ts) FROM new))"
query("merge_incremental", f"{_MERGED} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\", volume FROM merged")(lambda s, d: ingest.merge_incremental(*_old_new(s, d)).select("ticker", "ts", "close", "volume"))
query("manifest", f"WITH {I.SPARSE} SELECT ticker, '1d' AS interval, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS \"end\", count(*) AS rows, 'test' AS source, 2 AS version FROM bars GROUP BY ticker")(
    lambda s, d: ingest.manifest(I.sparse(s, d), "1d", "test").drop("updated_at")
)


def _requested(s, d):
    return I.sparse(s, d).select("ticker").union(s.createDataFrame([("unknown",)], "ticker string"))


def _plan(s, d, interval):
    return ingest.fetch_plan(_requested(s, d), I.sparse(s, d).where("ticker <> '7'"), F.lit(interval), F.lit(date(2024, 1, 30)))


def _plan_sql(days: int, shift: int) -> str:
    return f"""WITH {I.SPARSE}, req AS (SELECT DISTINCT ticker FROM bars UNION ALL SELECT 'unknown'),
l AS (SELECT ticker, max(ts) AS m FROM bars WHERE ticker <> '7' GROUP BY ticker),
p AS (SELECT req.ticker, m, CASE WHEN m IS NULL THEN DATE '2024-01-30' - {days} ELSE m::DATE + {shift} END AS st FROM req LEFT JOIN l USING (ticker))
SELECT ticker, {_stamp('m', 'cached_max_ts')}, strftime(st, '%Y-%m-%d') AS fetch_start, st <= DATE '2024-01-30' AS needs_fetch FROM p"""


query("fetch_plan", _plan_sql(12775, 1))(lambda s, d: _plan(s, d, "1d"))
query("fetch_plan_intraday", _plan_sql(60, 0))(lambda s, d: _plan(s, d, "15m"))


@query(
    "apply_fetch",
    f"""WITH {_OLD}, {_NEW}, pl AS (SELECT ticker, max(ts)::DATE + 1 AS st FROM old GROUP BY ticker),
add AS (SELECT new.* FROM new LEFT JOIN pl USING (ticker) WHERE st IS NULL OR ts::DATE >= st)
SELECT ticker, {_stamp('ts')}, round("close", 6) AS "close" FROM (SELECT * FROM add UNION ALL SELECT * FROM old)""",
)
def _apply(s, d):
    old, new = _old_new(s, d)
    requested = old.select("ticker").union(new.select("ticker"))
    return ingest.apply_fetch(ingest.fetch_plan(requested, old, F.lit("1d"), F.lit(TODAY)), new, old).select("ticker", "ts", "close")


@query("replace_suspects", f"""WITH {_OLD}, {_NEW}, sus AS (SELECT ticker FROM new WHERE ticker IN ('1', '2', '3') GROUP BY ticker)
SELECT ticker, {_stamp('ts')}, round("close", 6) AS "close" FROM (SELECT * FROM old WHERE ticker NOT IN (SELECT ticker FROM sus) UNION ALL SELECT * FROM new WHERE ticker IN (SELECT ticker FROM sus))""")
def _suspects(s, d):
    old, new = _old_new(s, d)
    return ingest.replace_suspects(old, new, s.createDataFrame([("1",), ("2",), ("3",), ("nobody",)], "ticker string")).select("ticker", "ts", "close")


@query("hydrate_missing", f"""WITH {_OLD}, {_NEW} SELECT ticker, {_stamp('ts')} FROM (SELECT ticker, ts FROM old WHERE ticker > '5' UNION ALL SELECT ticker, ts FROM new WHERE ticker NOT IN (SELECT ticker FROM old WHERE ticker > '5'))""")
def _hydrate(s, d):
    old, new = _old_new(s, d)
    return ingest.with_fallback(old.where("ticker > '5'"), new).select("ticker", "ts")


query("lookback_trim", f"WITH {I.SPARSE} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\" FROM bars WHERE ts >= TIMESTAMP '2024-01-11' AND ticker IN ('1', '2', '5')")(
    lambda s, d: ingest.price_history(I.sparse(s, d), ["1", "2", "5"], 10, TODAY).select("ticker", "ts", "close")
)


@query("missing_cache", f"""WITH {I.DENSE}, req AS (SELECT ticker FROM (VALUES ('click'), ('view'), ('nothing')) v(ticker)), iv AS (SELECT unnest(['1d', '1h']) AS interval)
SELECT interval, ticker, 'missing_cache' AS reason FROM req CROSS JOIN iv WHERE NOT (interval = '1d' AND ticker IN (SELECT ticker FROM bars) AND ticker <> 'view')""")
def _missing(s, d):
    requested = s.createDataFrame([("click",), ("view",), ("nothing",)], "ticker string")
    known = ingest.manifest(I.dense(s, d), "1d", "test").withColumn("version", F.when(F.col("ticker") == "view", 1).otherwise(2))
    return ingest.missing_report(requested, known, ["1d", "1h"]).drop("timestamp")


@query("download_outcome", f"WITH {I.DENSE}, req AS (SELECT ticker FROM (VALUES ('click'), ('nothing')) v(ticker)) SELECT ticker, ticker IN (SELECT ticker FROM bars) AS ok FROM req")
def _outcome(s, d):
    return ingest.download_outcome(s.createDataFrame([("click",), ("nothing",)], "ticker string"), I.dense(s, d))


@query("refresh_intervals", f"WITH {I.DENSE}, h AS (SELECT * FROM ({'WITH ' + I.HOURLY + ' SELECT * FROM bars'})) SELECT interval, ticker, count(*) AS n FROM (SELECT '1d' AS interval, ticker, ts FROM bars WHERE ts >= DATE '2024-01-11' UNION ALL SELECT '1h', ticker, ts FROM h WHERE ts >= DATE '2024-01-26') GROUP BY ALL")
def _refresh(s, d):
    both = I.dense(s, d).withColumn("interval", F.lit("1d")).unionByName(B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type").withColumn("interval", F.lit("1h")))
    return ingest.refreshed_intervals(both, {"1d": 20, "1h": 5}, TODAY).groupBy("interval", "ticker").agg(F.count(F.lit(1)).alias("n"))


# -- universe -----------------------------------------------------------------------
query("universe_clean", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM clean")(lambda s, d: universe.clean(I.companies(s, d)).select("rank", "company", F.col("normalized_ticker").alias("ticker")))
query("universe_build", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM clean ORDER BY rank, ticker LIMIT 20")(lambda s, d: universe.build(I.companies(s, d), 20))


@query("universe_history", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM clean WHERE ticker LIKE '%-1' OR ticker LIKE '%-4' ORDER BY rank, ticker LIMIT 10")
def _history(s, d):
    raw = I.companies(s, d)
    return universe.build(raw, 10, universe.clean(raw).where("normalized_ticker like '%-1' or normalized_ticker like '%-4'").select(F.col("normalized_ticker").alias("ticker")))


def _wanted(s, d, extra):
    rows = universe.clean(I.companies(s, d)).select(F.col("normalized_ticker").alias("ticker"), "company", F.col("rank").cast("long").alias("ord"))
    return rows.union(s.createDataFrame([("ZZZ", "Unknown", -1)], "ticker string, company string, ord long")) if extra else rows


query("rank_align", f"WITH {I.COMPANIES} SELECT rank, company, ticker FROM clean")(lambda s, d: universe.align(universe.clean(I.companies(s, d)), _wanted(s, d, False)))
query("rank_align_fallback", f"WITH {I.COMPANIES} SELECT row_number() OVER (ORDER BY rank)::INT AS rank, company, ticker FROM (SELECT rank, company, ticker FROM clean UNION ALL SELECT -1, 'Unknown', 'ZZZ')")(
    lambda s, d: universe.align(universe.clean(I.companies(s, d)), _wanted(s, d, True))
)
query("ticker_set_diff", f"WITH {I.COMPANIES} SELECT ticker, 'added' AS change FROM clean WHERE rank > 10 AND rank <= 15 UNION ALL SELECT ticker, 'removed' FROM clean WHERE rank < 5")(
    lambda s, d: universe.ticker_changes(*[universe.clean(I.companies(s, d)).where(c).select(F.col("normalized_ticker").alias("ticker")) for c in ("rank <= 10", "rank >= 5 and rank <= 15")])
)
query("scraped_pairs", "SELECT row_number() OVER (ORDER BY o)::INT AS rank, arg_min(company, o) AS company, ticker FROM (SELECT s_suppkey AS o, s_name AS company, 'N' || s_nationkey AS ticker FROM supplier) t, (SELECT 1) GROUP BY ticker, o QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY o) = 1")(
    lambda s, d: universe.ranked_pairs(I.read(s, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("company"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker")))
)
SQL["scraped_pairs"] = "SELECT row_number() OVER (ORDER BY o)::INT AS rank, company, ticker FROM (SELECT min(s_suppkey) AS o, arg_min(s_name, s_suppkey) AS company, 'N' || s_nationkey AS ticker FROM supplier GROUP BY s_nationkey)"

# -- calendar and validation ----------------------------------------------------------
_SESSIONS = """days AS (SELECT unnest(generate_series({a}, {b}, INTERVAL 1 DAY))::DATE AS d),
y AS (SELECT *, year(d) AS y, month(d) AS m, day(d) AS dd, isodow(d) AS w FROM days),
e AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e),
k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
p AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS p FROM k),
q AS (SELECT d, y, m, dd, w, make_date(y, (h + l - 7 * p + 114) // 31, (h + l - 7 * p + 114) % 31 + 1) - 2 AS friday FROM p),
fixed(fm, fd, since) AS (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (12, 25, 0)),
obs AS (SELECT DISTINCT CASE isodow(f) WHEN 6 THEN f - 1 WHEN 7 THEN f + 1 ELSE f END AS d FROM (SELECT make_date(yy, fm, fd) AS f, yy, since FROM fixed CROSS JOIN (SELECT unnest(generate_series(1980, 2031)) AS yy)) WHERE yy >= since),
sessions AS (SELECT d AS session FROM q WHERE w <= 5 AND d <> friday AND d NOT IN (SELECT d FROM obs)
  AND NOT (m = 1 AND w = 1 AND dd BETWEEN 15 AND 21 AND y >= 1986) AND NOT (m = 2 AND w = 1 AND dd BETWEEN 15 AND 21)
  AND NOT (m = 5 AND w = 1 AND dd >= 25) AND NOT (m = 9 AND w = 1 AND dd <= 7) AND NOT (m = 11 AND w = 4 AND dd BETWEEN 22 AND 28)
  AND d NOT IN (DATE '1985-09-27', DATE '1994-04-27', DATE '2001-09-11', DATE '2001-09-12', DATE '2001-09-13', DATE '2001-09-14', DATE '2004-06-11', DATE '2007-01-02', DATE '2012-10-29', DATE '2012-10-30', DATE '2018-12-05'))"""
_JAN = _SESSIONS.format(a="DATE '2024-01-01'", b="DATE '2024-01-31'")
query("trading_sessions", f"WITH {_SESSIONS.format(a=chr(68) + 'ATE ' + chr(39) + '1985-01-01' + chr(39), b=chr(68) + 'ATE ' + chr(39) + '2030-12-31' + chr(39))} SELECT strftime(session, '%Y-%m-%d') AS session FROM sessions")(
    lambda s, d: calendar.sessions(s, date(1985, 1, 1), date(2030, 12, 31)).select("session")
)


@query("session_orders", f"WITH {_SESSIONS.format(a='(SELECT min(o_orderdate)::DATE FROM orders)', b='(SELECT max(o_orderdate)::DATE FROM orders)')} SELECT strftime(session, '%Y-%m-%d') AS session, count(o_orderkey) AS n FROM sessions LEFT JOIN orders ON o_orderdate::DATE = session GROUP BY session")
def _session_orders(s, d):
    """Orders of each trading session between the first and the last order."""
    orders = I.read(s, d, "orders").withColumn("session", F.to_date("o_orderdate"))
    first, last = orders.agg(F.min("session"), F.max("session")).first()
    return calendar.sessions(s, first, last).select("session").join(orders.groupBy("session").agg(F.count(F.lit(1)).alias("n")), "session", "left").select("session", F.coalesce("n", F.lit(0)).alias("n"))



def _jan(s):
    return calendar.sessions(s, date(2024, 1, 1), TODAY)


query("business_day_gaps", f"WITH {I.SPARSE}, {_JAN}, o AS (SELECT DISTINCT ticker, ts::DATE AS session FROM bars), sp AS (SELECT ticker, min(session) AS a, max(session) AS b FROM o GROUP BY ticker) SELECT ticker, strftime(s.session, '%Y-%m-%d') AS session FROM sp JOIN sessions s ON s.session BETWEEN a AND b WHERE (ticker, s.session) NOT IN (SELECT (ticker, session) FROM o)")(
    lambda s, d: validate.business_day_gaps(I.sparse(s, d), _jan(s))
)
_INTRA = f"""WITH {I.HOURLY.replace("date_trunc('hour', ts)", "time_bucket(INTERVAL 15 MINUTE, ts)")}, {_JAN},
i AS (SELECT ticker, ts, ts::DATE AS session, lag(ts) OVER (PARTITION BY ticker, ts::DATE ORDER BY ts) AS prev FROM bars JOIN sessions ON sessions.session = ts::DATE WHERE ts::TIME BETWEEN TIME '09:30:00' AND TIME '16:00:00'),
g AS (SELECT ticker, unnest(generate_series(prev + INTERVAL 15 MINUTE, ts - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM i WHERE ts - prev > INTERVAL 15 MINUTE)"""


def _quarters(s, d):
    return B.from_ticks(I.read(s, d, "events"), B.minutes(15), "event_type")


query("intraday_gaps", f"{_INTRA} SELECT DISTINCT ticker, {_stamp('ts')} FROM g")(lambda s, d: validate.intraday_gaps(_quarters(s, d), _jan(s), "15m"))
query("intraday_allowed_gaps", f"{_INTRA} SELECT DISTINCT ticker, {_stamp('ts')} FROM g WHERE hour(ts) <> 12")(
    lambda s, d: validate.intraday_gaps(_quarters(s, d), _jan(s), "15m", _jan(s).select(F.explode(F.expr("sequence(session + interval 12 hours, session + interval '12:45' hour to minute, interval 15 minutes)")).alias("ts")))
)
query("spacing_gaps", f"WITH {I.SPARSE}, x AS (SELECT ticker, epoch(ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts)) AS s FROM bars) SELECT ticker, round(max(s) / 60, 6) AS widest FROM x GROUP BY ticker HAVING max(s) > 172800")(lambda s, d: validate.spacing_gaps(I.sparse(s, d), "2d"))
query("period_gaps", f"WITH {I.BRANDS} SELECT ticker, len(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 7 DAY))::BIGINT AS expected, count(*) AS rows FROM bars GROUP BY ticker HAVING len(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 7 DAY)) <> count(*)")(lambda s, d: validate.period_gaps(I.brands(s, d), "wk"))


@query("validation_violations", f"""WITH {_OLD}, {_NEW}, b AS (SELECT ticker, ts, "close" FROM old UNION ALL SELECT ticker, ts, "close" FROM new), m AS (SELECT ticker, min(ts) AS a, max(ts) AS z, count(*) AS n FROM old GROUP BY ticker),
g AS (SELECT ticker, count(*) AS n, count(DISTINCT ts) AS u, min(ts) AS a, max(ts) AS z FROM b GROUP BY ticker)
SELECT ticker, 'duplicate_timestamps' AS rule FROM g JOIN m USING (ticker) WHERE g.n <> u UNION ALL SELECT ticker, 'date_range' FROM g JOIN m USING (ticker) WHERE g.a <> m.a OR g.z <> m.z UNION ALL SELECT ticker, 'row_count' FROM g JOIN m USING (ticker) WHERE g.n <> m.n""")
def _violations(s, d):
    old, new = _old_new(s, d)
    return validate.violations(old.unionByName(new), ingest.manifest(old, "1d", "x"))


# -- annotations --------------------------------------------------------------------
_AT = "strftime(make_timestamp(tm * 1000000), '%Y-%m-%d %H:%M:%S')"
query("annotations_latest", f"WITH {I.LOG} SELECT id, ticker, note, {_AT} AS updated_at, role FROM log QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY tm DESC, id DESC) = 1")(lambda s, d: annotations.latest(I.annotation_log(s, d)))
query("annotations_history", f"WITH {I.LOG} SELECT id, ticker, note, {_AT} AS updated_at, role FROM log WHERE ticker = 'T3' ORDER BY id DESC LIMIT 50")(lambda s, d: annotations.history(I.annotation_log(s, d), "T3", 50))


def _sides(s, d):
    log = I.annotation_log(s, d)
    server = annotations.latest(log.where("role = 'assistant'"))
    pending = log.where("role = 'user'").select("ticker", "note", (F.col("updated_at") + F.expr("make_interval(0, 0, 0, 0, 0, 0, (id % 7) * 30)")).alias("client_timestamp"))
    return server, pending.dropDuplicates(["ticker", "note", "client_timestamp"])


_SIDES = f"{I.LOG}, server AS (SELECT * FROM log WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY tm DESC, id DESC) = 1), pending AS (SELECT DISTINCT ticker, note, tm + (id % 7) * 30 AS tm FROM log WHERE role = 'user')"
query("annotations_merged", f"WITH {_SIDES} SELECT ticker, note, {_AT} AS ts, origin FROM (SELECT ticker, note, tm, 'server' AS origin FROM server UNION ALL SELECT ticker, note, tm, 'pending' FROM pending) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY tm DESC, origin DESC, encode(note) DESC) = 1")(
    lambda s, d: annotations.merged(*_sides(s, d))
)
query("annotations_conflicts", f"""WITH {_SIDES}, x AS (SELECT p.ticker, p.note, p.tm, greatest(max(p.tm) OVER (PARTITION BY p.ticker ORDER BY p.tm, encode(p.note) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.tm) AS seen FROM pending p LEFT JOIN server s ON s.ticker = p.ticker)
SELECT ticker, note, {_AT} AS client_timestamp, CASE WHEN seen IS NULL OR tm > seen THEN 'applied' ELSE 'conflict' END AS outcome FROM x""")(lambda s, d: annotations.synced(*_sides(s, d)))

# -- functions and decoding -----------------------------------------------------------
query("formula_escape", "SELECT p_partkey, CASE WHEN regexp_matches(x, '^[=+@-]') THEN chr(39) || x WHEN regexp_matches(x, '^[\\t\\n]') THEN ' ' || x ELSE x END AS name FROM (SELECT p_partkey, substr('=+-@' || chr(9) || 'ab', (p_partkey % 7 + 1)::INT, 1) || p_name AS x FROM part)")(
    lambda s, d: I.read(s, d, "part").select("p_partkey", T.escaped_formula(F.concat(F.expr("substr(concat('=+-@', char(9), 'ab'), cast(p_partkey % 7 + 1 as int), 1)"), "p_name")).alias("name"))
)
query("normalize_ticker", "SELECT s_suppkey, replace(upper(trim(replace(s_name, '#', '.'))), '.', '-') AS ticker FROM supplier")(lambda s, d: I.read(s, d, "supplier").select("s_suppkey", T.normalized_ticker(F.replace("s_name", F.lit("#"), F.lit("."))).alias("ticker")))
query("periods_per_year", "SELECT p_size, round(CASE p_partkey % 5 WHEN 0 THEN 98280.0 WHEN 1 THEN 1638.0 WHEN 2 THEN 252.0 WHEN 3 THEN 52.0 ELSE 12.0 END / p_size, 6) AS periods, p_partkey FROM part")(
    lambda s, d: I.read(s, d, "part").select("p_partkey", "p_size", T.periods_per_year(F.concat(F.col("p_size").cast("string"), F.expr("element_at(array('m', 'H', 'd', 'wk', 'mo'), cast(p_partkey % 5 + 1 as int))"))).alias("periods"))
)
query("display_titles", "SELECT DISTINCT event_type, upper(event_type[1]) || lower(event_type[2:]) || ' Share' AS title FROM events")(lambda s, d: I.read(s, d, "events").select("event_type").distinct().select("event_type", T.title_of(F.concat("event_type", F.lit("_share"))).alias("title")))
query("redaction", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '***REDACTED***' ELSE 'x' || user_id END AS v FROM events")(
    lambda s, d: I.read(s, d, "events").select("event_id", F.map_values(T.redacted(F.create_map(F.when(F.col("event_id") % 2 == 0, F.lit("my_API_key")).otherwise(F.lit("user")), F.concat(F.lit("x"), F.col("user_id").cast("string")))))[0].alias("v"))
)
query("error_counts", "SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: ingest.error_counts(I.read(s, d, "events").withColumn("code", F.col("event_type"))))
query("price_projection", f"WITH {I.DENSE} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\", volume FROM bars")(lambda s, d: readers.projected(I.dense(s, d), ["TICKER", "Ts", "Close", "VOLUME"]))
query("date_only_check", f"WITH {I.SPARSE} SELECT DISTINCT ticker, FALSE AS has_time FROM bars")(lambda s, d: readers.has_time_parts(I.sparse(s, d)))
query("discovered_tickers", "SELECT DISTINCT event_type AS ticker FROM events UNION SELECT DISTINCT r_name FROM region")(lambda s, d: readers.discovered_tickers(I.dense(s, d), [I.read(s, d, "region").select(F.col("r_name").alias("ticker")), I.dense(s, d)]))
_TICKS = "SELECT user_id::VARCHAR AS ticker, epoch(date_trunc('second', ts))::BIGINT AS t, value, event_id FROM events"


@query("json_decode_repair", f"""WITH x AS (SELECT ticker, t, value, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 2 END AS adj, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS cl, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS vol FROM ({_TICKS})), y AS (SELECT *, coalesce(adj, cl) AS px FROM x)
SELECT ticker, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, round(px, 6) AS open, round(px, 6) AS high, round(value, 6) AS low, round(coalesce(cl, px), 6) AS "close", round(px, 6) AS adj_close, coalesce(vol, 0) AS volume FROM y WHERE px IS NOT NULL""")
def _decode(s, d):
    x = I.read(s, d, "events").select(F.col("user_id").cast("string").alias("ticker"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value", "event_id")
    row = F.sort_array(F.collect_list(F.struct("t", "event_id", "value")))
    # a payload holds an instrument's day
    g = x.groupBy("ticker", F.floor(F.col("t") / 86400).alias("day")).agg(row.alias("r"))
    pick = lambda e: F.expr(f"transform(r, x -> {e})")
    quote = F.array(F.struct(pick("x.value").alias("low"), pick("if(x.event_id % 2 = 0, null, x.value)").alias("close"), pick("if(x.event_id % 5 = 0, null, x.event_id)").alias("volume")))
    adj = F.array(F.struct(pick("if(x.event_id % 3 = 0, null, x.value / 2)").alias("adjclose")))
    result = F.array(F.struct(pick("x.t").alias("timestamp"), F.struct(quote.alias("quote"), adj.alias("adjclose")).alias("indicators")))
    payloads = g.select("ticker", F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("payload"))
    return readers.repaired_quotes(readers.quote_rows(payloads))[0]


@query("split_decode", f"WITH {I.DENSE} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\" FROM bars WHERE ticker = 'click'")
def _split(s, d):
    rows = I.dense(s, d).groupBy("ts").agg(F.max(F.when(F.col("ticker") == "click", F.col("close"))).alias("a"), F.max(F.when(F.col("ticker") == "view", F.col("close"))).alias("b"))
    g = rows.agg(F.sort_array(F.collect_list(F.struct("ts", "a", "b"))).alias("r"))
    cols = F.expr("array(array('Close', 'click'), array('Close', 'view'))")
    payload = F.to_json(F.struct(cols.alias("columns"), F.expr("transform(r, x -> cast(x.ts as string))").alias("index"), F.expr("transform(r, x -> array(x.a, x.b))").alias("data")))
    return readers.split_bars(g.select(payload.alias("payload")), "click").select("ticker", "ts", "close")


@query("wide_to_long", f"WITH {I.DENSE} SELECT ticker, {_stamp('ts')}, round(\"close\", 6) AS \"close\", round(open, 6) AS open FROM bars")
def _wide(s, d):
    bars = I.dense(s, d)
    # the instruments are the matrix' columns
    names = [r.ticker for r in bars.select("ticker").distinct().orderBy("ticker").collect()]
    wide = bars.groupBy("ts").pivot("ticker", names).agg(F.first("open").alias("Open"), F.first("close").alias("Close"))
    return readers.wide_to_long(wide.toDF("ts", *[c for t in names for c in (f"Open|{t}", f"{t}|Close")]))


query("date_time_check", f"WITH {I.HOURLY} SELECT ticker, bool_or(hour(ts) <> 0) AS has_time FROM bars GROUP BY ticker")(lambda s, d: readers.has_time_parts(B.from_ticks(I.read(s, d, "events"), B.minutes(60), "event_type")))
query("content_digest", None)(lambda s, d: sinks.content_digest(I.dense(s, d)))
query("last_event_by_window", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")(lambda s, d: sanitize.latest_rows(I.read(s, d, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id"))
