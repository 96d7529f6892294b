"""The engine's inputs made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.operators import bars as B


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by event type: every type has a bar on every day."""
    return B.from_ticks(read(spark, sf_dir, "events"), B.day(), "event_type")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by user: many days are missing."""
    return B.from_ticks(read(spark, sf_dir, "events"), B.day(), "user_id")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bars but for one type on one day."""
    return dense(spark, sf_dir).where("not (ticker = 'click' and to_date(ts) = date'2024-01-10')")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly closes by part brand: the highest unit price of the lines shipped."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey).where("l_quantity > 0")
    return j.groupBy(F.col("p_brand").alias("ticker"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg((F.floor(F.max(F.col("l_extendedprice") / F.col("l_quantity")) * 100) / 100.0).cast("double").alias("close"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe list: suppliers, with tickers that repeat, differ in case and are sometimes invalid."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    t = F.concat(F.when(F.col("s_suppkey") % 11 == 3, F.lit("9")).otherwise(F.lit("")), F.lower(F.replace("n_name", F.lit("_"), F.lit("."))), F.lit("."), (F.col("s_suppkey") % 7).cast("string"))
    return s.select((F.col("s_suppkey") + 1).cast("int").alias("rank"), F.col("s_name").alias("company"), F.concat(F.lit(" "), t).alias("ticker"))


def event_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe for the dense bars: regions as companies; one type has none, one region no type."""
    names = spark.createDataFrame([(1, "click"), (2, "view"), (3, "purchase"), (4, "error"), (0, "nowhere")], "k int, ticker string")
    r = read(spark, sf_dir, "region")
    return names.join(r, F.col("k") == F.col("r_regionkey")).select((F.col("k") + 1).alias("rank"), F.col("r_name").alias("company"), "ticker")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company panel: customers' orders by quarter, some features missing."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_custkey").cast("string").alias("company"), F.to_date(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp"))).alias("date"), F.col("c_mktsegment").alias("sector"))
    out = g.agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.max("o_totalprice"), 2).alias("largest"), F.max("c_acctbal").alias("balance"))
    return out.withColumn("balance", F.when(F.col("balance") >= 500, F.col("balance"))).withColumn("largest", F.when(F.col("n_orders") != 2, F.col("largest")))


FEATURES = ["n_orders", "revenue", "largest", "balance"]


def annotation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("T"), (F.col("conv_id") % 40).cast("string")).alias("ticker"), F.col("text").alias("note"), ts.alias("updated_at"), "role")


def _bars_sql(key: str, unit: str = "day") -> str:
    return f"""bars AS (
  SELECT {key}::VARCHAR AS ticker, date_trunc('{unit}', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close", count(*) AS volume
  FROM events WHERE value > 0 GROUP BY ALL)"""


DENSE = _bars_sql("event_type")
SPARSE = _bars_sql("user_id")
HOLED = _bars_sql("event_type").replace("value > 0", "value > 0 AND NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11')")
HOURLY = _bars_sql("event_type", "hour")
BRANDS = """bars AS (
  SELECT p_brand AS ticker, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, floor(max(l_extendedprice / l_quantity) * 100) / 100.0 AS "close"
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY ALL)"""
#: the dense matrix of all dates and instruments, and both kinds of grid return
GRID = """grid AS (
  SELECT t.ticker, d.ts, b."close" AS px
  FROM (SELECT DISTINCT ts FROM bars) d CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker AND b.ts = d.ts
), rets AS (
  SELECT *, px / lag(px) OVER w - 1 AS r, ln(px / lag(px) OVER w) AS lr FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY ts)
)"""
COMPLETE = """cc AS (
  SELECT * FROM rets WHERE ts IN (SELECT ts FROM rets GROUP BY ts HAVING count(r) = (SELECT count(DISTINCT ticker) FROM bars))
)"""
COMPANIES = """companies AS (
  SELECT (s_suppkey + 1)::INT AS rank, s_name AS company,
         ' ' || CASE WHEN s_suppkey % 11 = 3 THEN '9' ELSE '' END || lower(replace(n_name, '_', '.')) || '.' || (s_suppkey % 7) AS ticker
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), clean AS (
  SELECT rank, company, n AS ticker FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY rank, company) AS k
    FROM (SELECT rank, company, replace(upper(trim(ticker)), '.', '-') AS n FROM companies) WHERE regexp_full_match(n, '[A-Z]+[A-Z0-9.-]*')
  ) WHERE k = 1
)"""
EVENT_UNIVERSE = """univ AS (
  SELECT k + 1 AS rank, r_name AS company, ticker
  FROM (VALUES (1, 'click'), (2, 'view'), (3, 'purchase'), (4, 'error'), (0, 'nowhere')) v(k, ticker) JOIN region ON r_regionkey = k
)"""
PANEL = """panel AS (
  SELECT company, date, sector, n_orders, revenue, CASE WHEN n_orders <> 2 THEN largest END AS largest, CASE WHEN balance >= 500 THEN balance END AS balance
  FROM (SELECT c_custkey::VARCHAR AS company, date_trunc('quarter', o_orderdate)::DATE AS date, c_mktsegment AS sector, count(*)::DOUBLE AS n_orders,
               round(sum(o_totalprice), 2) AS revenue, round(max(o_totalprice), 2) AS largest, max(c_acctbal) AS balance
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
)"""
LOG = """log AS (
  SELECT conv_id * 100 + turn AS id, 'T' || (conv_id % 40) AS ticker, text AS note, 1700000000 + turn * 60 AS tm, role FROM conversations
)"""
