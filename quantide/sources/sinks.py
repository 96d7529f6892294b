"""Sinks: the bar store, exports, payloads and digests."""

from __future__ import annotations

import json
import sqlite3
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantide.functions.shared import written
from quantide.functions.text import escape_formulas
from quantide.operators.ingest import manifest
from quantide.operators.validate import gaps, violations
from quantide.params import ValidationError
from quantide.schema import BARS
from quantide.sources.readers import BarStore, has_time_parts, legacy_csv

#: rows that an export to one local file or to the driver may have
EXPORT_ROWS = 1_000_000


def save_bars(store: BarStore, bars: DataFrame, interval: str, source: str, validate: bool = True, sessions: DataFrame | None = None, allowed_gaps: DataFrame | None = None) -> None:
    """Replace the stored bars of the instruments present; other partitions stay. An empty frame is refused.

    All checks come before anything is written; with ``sessions`` given, gaps other than the allowed ones are refused too. How a
    save that stops halfway leaves the store is up to it: a ``SnapshotStore`` then shows the state before.
    """
    if bars.isEmpty():
        raise ValidationError("no bars to store", interval=interval)
    entries = manifest(bars, interval, source)
    if validate and not (bad := violations(bars, entries)).isEmpty():
        raise ValidationError("bars break rules", found=[tuple(r) for r in bad.limit(20).collect()])
    if validate and sessions is not None and not (bad := gaps(bars, sessions, interval, allowed_gaps)).isEmpty():
        raise ValidationError("bars have gaps", found=[tuple(r) for r in bad.limit(20).collect()])
    rows = bars.select(*[(F.col(f.name) if f.name in bars.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in BARS]).withColumn("interval", F.lit(interval))
    store.write(rows, entries)


def save_csv(df: DataFrame, path: str, escape: bool = False, one_file: bool = False) -> None:
    """CSV parts with headers; one file only where it is asked for and the rows are few (``EXPORT_ROWS``)."""
    if one_file and df.limit(EXPORT_ROWS + 1).count() > EXPORT_ROWS:
        raise ValidationError("too many rows for one file", most=EXPORT_ROWS)
    out = escape_formulas(df) if escape else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def save_sqlite(df: DataFrame, path: str, table: str = "volatility") -> int:
    """Replace a table of a local SQLite file by a result of bounded size; returns its rows."""
    rows = df.limit(EXPORT_ROWS + 1).collect()
    if len(rows) > EXPORT_ROWS:
        raise ValidationError("too many rows for a local file", most=EXPORT_ROWS)
    names = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE "{table}" ({names})')
        plain = [[x if isinstance(x, (int, float, str, bytes, type(None))) else str(x) for x in r] for r in rows]
        con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', plain)
    return len(rows)


def append_failures(df: DataFrame, path: str) -> None:
    df.select("timestamp", "interval", "ticker", "reason").write.mode("append").option("header", True).csv(path)


def convert_legacy(store: BarStore, path: str, interval: str = "1d", dry_run: bool = False, delete: bool = False) -> DataFrame:
    """Store legacy CSV bars with source repair, unchecked; intraday files without times are left out. Returns the tickers.

    With ``delete`` the files of stored instruments are removed once the save has gone through.
    """
    bars = legacy_csv(store.spark, path)
    if interval.endswith(("m", "h")):
        bars = bars.join(has_time_parts(bars).where("has_time").select("ticker"), "ticker", "left_semi")
    tickers = bars.select("ticker").distinct()
    if dry_run:
        return tickers
    save_bars(store, bars, interval, "repair", validate=False)
    if not delete:
        return tickers
    tickers = written(tickers, "converted")
    names = tickers.collect()  # a file each
    where = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(store.spark._jsparkSession.sessionState().newHadoopConf())
    stored = {quote(r.ticker, safe="") for r in names} | {r.ticker for r in names}
    for status in fs.globStatus(where) or []:
        if status.getPath().getName().removesuffix(".gz").removesuffix(".csv") in stored:
            fs.delete(status.getPath(), False)
    return tickers


def records_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def split_payload(bars: DataFrame, fields: list[str]) -> dict:
    """columns, index and data of a bounded matrix, rows by time; an empty one has only empty data."""
    rows = bars.select("ts", "ticker", *fields).limit(EXPORT_ROWS + 1).collect()
    if len(rows) > EXPORT_ROWS:
        raise ValidationError("too many rows for one payload", most=EXPORT_ROWS)
    if not rows:
        return {"data": []}
    tickers, stamps = sorted({r.ticker for r in rows}), sorted({r.ts for r in rows})
    at = {(r.ts, r.ticker): r for r in rows}
    columns = [(f, t) for f in fields for t in tickers]
    data = [[(at[s, t][f] if (s, t) in at else None) for f, t in columns] for s in stamps]
    return {"columns": [list(c) for c in columns], "index": [s.isoformat() for s in stamps], "data": data}


def canonical(payload: object) -> tuple[str, str]:
    """JSON with sorted keys and no spaces, and its SHA-256 as a content tag."""
    import hashlib

    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
    return text, hashlib.sha256(text.encode()).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows and digest of the table's rows in any order.

    Row hashes are added up in two halves modulo 2**64, so no task sees all rows.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    g = df.select(part(1).alias("a"), part(17).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    return g.select("rows", F.sha2(F.concat_ws(":", "rows", F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))
