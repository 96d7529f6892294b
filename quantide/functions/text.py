"""Column functions on names, text and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantide.params import BACKFILL_DAYS, REDACTED, SENSITIVE, TRADING_DAYS_PER_YEAR, TRADING_MINUTES_PER_DAY

TICKER_RULE = "^[A-Z]+[A-Z0-9.-]*$"


def normalized_ticker(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))


def escaped_formula(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).when(c.rlike("^[\\t\\n]"), F.concat(F.lit(" "), c)).otherwise(c)


def escape_formulas(df: DataFrame) -> DataFrame:
    """Every string column escaped; other columns as they are."""
    return df.withColumns({c: escaped_formula(F.col(c)) for c, t in df.dtypes if t == "string"})


def title_of(c: Column) -> Column:
    return F.when(F.trim(c) == "", c).otherwise(F.initcap(F.replace(F.trim(c), F.lit("_"), F.lit(" "))))


def redacted(c: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike(SENSITIVE.pattern), F.lit(REDACTED)).otherwise(v))


def periods_per_year(interval: Column) -> Column:
    """Bars in a trading year from an interval column; null where it is no interval."""
    size = F.regexp_extract(F.lower(interval), r"^\s*(\d+(?:\.\d+)?)\s*(m|h|d|wk|mo)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(interval), r"^\s*(\d+(?:\.\d+)?)\s*(m|h|d|wk|mo)\s*$", 2)
    minutes = float(TRADING_DAYS_PER_YEAR * TRADING_MINUTES_PER_DAY)
    year = F.when(unit == "m", minutes).when(unit == "h", minutes / 60).when(unit == "d", float(TRADING_DAYS_PER_YEAR)).when(unit == "wk", 52.0).when(unit == "mo", 12.0)
    return F.try_divide(year, F.when(size > 0, size))


def backfill_start(interval: Column, today: Column) -> Column:
    """The first day of a full backfill; null for unknown intervals."""
    days = F.create_map(*[F.lit(x) for k, v in BACKFILL_DAYS.items() for x in (k, v)])
    return F.date_sub(today, F.try_element_at(days, interval))
