"""Trading sessions of the New York exchange, by rule.

Holidays on a weekend are observed on the nearest workday. The table of holidays is
small (some ten a year) and made on the driver; sessions are a DataFrame.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One-off closures of whole days.
SPECIAL_CLOSURES = (
    date(1985, 9, 27),
    date(1994, 4, 27),
    date(2001, 9, 11),
    date(2001, 9, 12),
    date(2001, 9, 13),
    date(2001, 9, 14),
    date(2004, 6, 11),
    date(2007, 1, 2),
    date(2012, 10, 29),
    date(2012, 10, 30),
    date(2018, 12, 5),
)
OPEN, CLOSE = "09:30:00", "16:00:00"


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (the anonymous computus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _observed(day: date) -> date:
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(first: int, last: int) -> list[date]:
    """Holidays of the years first to last, special closures included."""
    found = {d for d in SPECIAL_CLOSURES if first <= d.year <= last}
    for y in range(first, last + 2):
        days = [
            _observed(date(y, 1, 1)),
            _nth(y, 1, 0, 3) if y >= 1986 else None,
            _nth(y, 2, 0, 3) if y >= 1971 else None,
            easter(y) - timedelta(days=2),
            (m := date(y, 5, 31)) - timedelta(days=m.weekday()),
            _observed(date(y, 6, 19)) if y >= 2021 else None,
            _observed(date(y, 7, 4)),
            _nth(y, 9, 0, 1),
            _nth(y, 11, 3, 4),
            _observed(date(y, 12, 25)),
        ]
        found.update(d for d in days if d is not None and first <= d.year <= last)
    return sorted(found)


def sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """session, open and close of every trading day from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session")).where("weekday(session) < 5")
    closed = spark.createDataFrame([(d,) for d in holidays(start.year, end.year)], "session date")
    days = days.join(F.broadcast(closed), "session", "left_anti")
    at = lambda t: F.to_timestamp(F.concat_ws(" ", F.col("session").cast("string"), F.lit(t)))
    return days.select("session", at(OPEN).alias("open"), at(CLOSE).alias("close"))
