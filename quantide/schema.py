"""Table shapes and the normalisation of raw bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "timestamp": TimestampType(), "date": DateType(), "double": DoubleType(), "int": IntegerType(), "bigint": LongType()}


def _struct(fields: str) -> StructType:
    """A schema from "name type, ..."; needs no session, unlike a DDL string."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


BARS = _struct("ticker string, ts timestamp, open double, high double, low double, close double, adj_close double, volume bigint")
UNIVERSE = _struct("rank int, company string, ticker string, normalized_ticker string")
MANIFEST = _struct("ticker string, interval string, start date, end date, rows bigint, source string, version int, updated_at timestamp")
ANNOTATIONS = _struct("ticker string, note string, updated_at timestamp, client_timestamp timestamp")
FAILURES = _struct("timestamp timestamp, interval string, ticker string, reason string")

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close")


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def coerced(c: Column) -> Column:
    """A finite double from a number or a string, else null."""
    return finite(c.try_cast("double"))


def normalise_bars(df: DataFrame) -> DataFrame:
    """Prices as finite doubles, volume as a whole number (0 where missing), ts as a timestamp; other columns stay."""
    out = {}
    for name, kind in df.dtypes:
        if name in PRICE_FIELDS:
            out[name] = coerced(F.col(name))
        elif name == "volume":
            out[name] = F.coalesce(coerced(F.col(name)).try_cast("bigint"), F.lit(0).cast("bigint"))
        elif name == "ts" and kind != "timestamp":
            out[name] = F.col(name).cast("timestamp")
    return df.withColumns(out)
