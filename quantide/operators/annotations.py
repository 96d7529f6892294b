"""Notes on instruments: an append log, its latest state, and offline changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantide.operators.sanitize import latest_rows
from quantide.params import ValidationError


def valid_note(note: str, most: int = 2000) -> str:
    n = note.strip()
    if not 1 <= len(n) <= most:
        raise ValidationError(f"a note has 1 to {most} characters")
    return n


def latest(log: DataFrame) -> DataFrame:
    """The newest entry of each instrument, ordered by ticker; of equal times the later id."""
    tie = [F.desc("id")] if "id" in log.columns else []
    return latest_rows(log, ["ticker"], [F.desc("updated_at"), *tie]).orderBy("ticker")


def history(log: DataFrame, ticker: str | None = None, limit: int | None = None) -> DataFrame:
    rows = log.where(F.col("ticker") == ticker) if ticker is not None else log
    rows = rows.orderBy(F.desc("id") if limit else F.asc("id"))
    return rows.limit(limit) if limit else rows


def upserted(log: DataFrame, new: DataFrame, at: Column | None = None) -> DataFrame:
    """The log with new entries (ticker, note, client_timestamp) appended, numbered on from its last id."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # numbered by offsets per day, so no window holds all rows
    dated = new.withColumn("_day", F.to_date("client_timestamp"))
    sizes = dated.groupBy("_day").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("_day").alias("_d"), (F.sum("n").over(Window.orderBy("_day")) - F.col("n")).alias("before"))
    k = F.row_number().over(Window.partitionBy("_day").orderBy("client_timestamp", "ticker"))
    numbered = dated.withColumn("k", k).join(before, F.col("_day").eqNullSafe(F.col("_d")))
    rows = numbered.crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("before") + F.col("k")).withColumn("updated_at", at if at is not None else F.current_timestamp())
    return log.unionByName(rows.withColumn("note", F.trim("note")).select(log.columns))


def merged(server: DataFrame, pending: DataFrame) -> DataFrame:
    """ticker, note, ts and origin: the newest of both sides; of equal times the server's."""
    s = server.select("ticker", "note", F.col("updated_at").alias("ts"), F.lit("server").alias("origin"))
    p = pending.select("ticker", "note", F.col("client_timestamp").alias("ts"), F.lit("pending").alias("origin"))
    return latest_rows(s.union(p), ["ticker"], [F.desc("ts"), F.desc("origin"), F.desc("note")])


def synced(server: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending changes with outcome: applied if strictly newer than all before them, else conflict.

    Changes of an instrument are replayed in the client's time order over the server's state.
    """
    w = Window.partitionBy("ticker").orderBy("client_timestamp", "note").rowsBetween(Window.unboundedPreceding, -1)
    j = pending.join(server.select("ticker", "updated_at"), "ticker", "left")
    seen = F.greatest(F.max("client_timestamp").over(w), F.col("updated_at"))
    return j.withColumn("outcome", F.when(seen.isNull() | (F.col("client_timestamp") > seen), "applied").otherwise("conflict")).drop("updated_at")
