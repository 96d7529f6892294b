"""Parameters, their validation, and structured errors."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta
from enum import Enum

TRADING_DAYS_PER_YEAR = 252
TRADING_MINUTES_PER_DAY = 390
LAMBDA = 0.94
ROLLING_WINDOWS = (30, 60, 90)
VAR_TAIL = 0.05
MANIFEST_VERSION = 2
LOOKBACK_DAYS, TOP_N, PRINT_TOP, MIN_DAYS = 252, 100, 5, 126

# Days of history that a full backfill asks for, by interval.
BACKFILL_DAYS = {"1m": 7, "5m": 60, "15m": 60, "30m": 60, "60m": 730, "1h": 730, "1d": 12775, "1wk": 14600, "1mo": 14600}

_YEAR_UNITS = {"m": TRADING_DAYS_PER_YEAR * TRADING_MINUTES_PER_DAY, "h": TRADING_DAYS_PER_YEAR * TRADING_MINUTES_PER_DAY / 60, "d": TRADING_DAYS_PER_YEAR, "wk": 52, "mo": 12}
_MINUTES = {"s": 1 / 60, "m": 1, "h": 60, "d": 1440, "wk": 10080, "w": 10080}


class ErrorCode(Enum):
    VALIDATION = "validation_error"
    CONFIGURATION = "configuration_error"
    DATA_SOURCE = "data_source_error"
    CACHE = "cache_error"
    COMPUTE = "compute_error"
    INTEGRATION = "integration_error"
    UNKNOWN = "unknown"


# Keys whose values never leave in an error's context or a table.
SENSITIVE = re.compile("password|passwd|secret|token|api_?key|auth|credential", re.I)
REDACTED = "***REDACTED***"


class EngineError(Exception):
    """An error with a code, a redacted context and its chain of causes."""

    code = ErrorCode.UNKNOWN

    def __init__(self, message: str, **context: object):
        super().__init__(message)
        self.context = {k: REDACTED if SENSITIVE.search(k) else v for k, v in context.items()}

    def describe(self, depth: int = 3) -> dict:
        chain, cause = [], self.__cause__
        while cause is not None and len(chain) < depth:
            chain.append(f"{type(cause).__name__}: {cause}")
            cause = cause.__cause__
        return {"code": self.code.value, "message": str(self), "context": self.context, "causes": chain}


class ValidationError(EngineError, ValueError):
    code = ErrorCode.VALIDATION


class ConfigurationError(EngineError):
    code = ErrorCode.CONFIGURATION


class DataSourceError(EngineError):
    code = ErrorCode.DATA_SOURCE


class CacheError(EngineError):
    code = ErrorCode.CACHE


class ComputeError(EngineError):
    code = ErrorCode.COMPUTE


def periods_per_year(interval: str) -> float:
    """Bars of an interval in a trading year; decimals are allowed, unknown units and sizes of 0 or less are not."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(m|h|d|wk|mo)\s*", interval.lower())
    if not m or float(m[1]) <= 0:
        raise ValidationError(f"not an interval: {interval!r}")
    return _YEAR_UNITS[m[2]] / float(m[1])


def interval_minutes(interval: str) -> float | None:
    """Minutes between bars, or None for months."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(s|m|h|d|wk|w|mo)", interval.lower())
    if not m:
        raise ValidationError(f"not an interval: {interval!r}")
    return None if m[2] == "mo" else float(m[1]) * _MINUTES[m[2]]


def is_intraday(interval: str) -> bool:
    return interval.lower().endswith(("m", "h"))


def is_daily(interval: str) -> bool:
    return interval.lower().endswith("d")


def full_backfill_start(interval: str, today: date) -> date:
    """The first day of a full backfill; KeyError for unknown intervals."""
    return today - timedelta(days=BACKFILL_DAYS[interval])


def lookback_cutoff(lookback_days: int, today: date) -> date:
    """Histories reach back twice the lookback in calendar days."""
    return today - timedelta(days=2 * lookback_days)


def normalise_ticker(ticker: str) -> str:
    return ticker.strip().upper().replace(".", "-")


def valid_ticker(ticker: str) -> str:
    t = ticker.strip().upper()
    if not re.fullmatch(r"[A-Z0-9.\-]{1,10}", t):
        raise ValidationError("not a ticker", ticker=ticker)
    return t


def valid_tickers(text: str, most: int = 100) -> list[str]:
    """Tickers of a comma-separated list, repeats kept."""
    found = [valid_ticker(x) for x in text.split(",") if x.strip()]
    if not found or len(found) > most:
        raise ValidationError(f"between 1 and {most} tickers are asked for", given=len(found))
    return found


def unique_in_order(items: Iterable[str], fold: bool = False) -> list[str]:
    """Items without repeats, first ones kept; ``fold`` ignores case."""
    first: dict[str, str] = {}
    for x in items:
        first.setdefault(x.lower() if fold else x, x)
    return list(first.values())


def valid_interval(interval: str) -> str:
    i = interval.strip().lower()
    if not re.fullmatch(r"[0-9]+(?:wk|mo|[smhdw])", i):
        raise ValidationError("not an interval", interval=interval)
    return i


def valid_metric(metric: str) -> str:
    m = metric.strip().lower()
    if not re.fullmatch(r"[a-z0-9_]+", m):
        raise ValidationError("not a metric name", metric=metric)
    return m


def valid_format(fmt: str) -> str:
    f = fmt.strip().lower()
    if f not in ("json", "parquet"):
        raise ValidationError("not an output format", format=fmt)
    return f


def valid_int(value: object, low: int, high: int | None = None, name: str = "value") -> int:
    """A whole number within bounds; booleans are not numbers here."""
    if isinstance(value, bool) or not isinstance(value, (int, str)) or isinstance(value, str) and not re.fullmatch(r"[+-]?\d+", value.strip()):
        raise ValidationError(f"{name} must be a whole number", value=value)
    n = int(value)
    if n < low or high is not None and n > high:
        raise ValidationError(f"{name} must be between {low} and {high}", value=n)
    return n


def valid_columns(text: str | None) -> list[str] | None:
    """Column selectors of a comma-separated list, without repeats that differ in case only."""
    if text is None:
        return None
    found = [x.strip() for x in text.split(",") if x.strip()]
    if not found or any(not re.fullmatch(r"[A-Za-z0-9 _\-]+", x) for x in found):
        raise ValidationError("not a list of columns", columns=text)
    return unique_in_order(found, fold=True)


@dataclass(frozen=True)
class MetricParams:
    """What a metric may use. ``min_periods`` None: no such filter, or the metric's own default."""

    interval: str = "1d"
    min_periods: int | None = None
    risk_free: float = 0.0
    confidence: float = VAR_TAIL
    ewma_lambda: float = LAMBDA
    tickers: tuple[str, ...] | None = None
    options: dict = field(default_factory=dict, hash=False)

    @property
    def annual(self) -> float:
        return periods_per_year(self.interval)
