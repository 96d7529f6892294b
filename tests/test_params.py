from datetime import date

import pytest

from quantide import params as P
from quantide.operators import calendar


@pytest.mark.parametrize(("interval", "want"), [("1d", 252), ("5d", 50.4), ("1h", 1638), ("30m", 3276), ("1wk", 52), ("1mo", 12), ("1.5d", 168), ("1D", 252)])
def test_periods_per_year(interval, want):
    assert P.periods_per_year(interval) == pytest.approx(want)


@pytest.mark.parametrize("interval", ["bad", "0m", "-5d", "10", "5w", "1s"])
def test_bad_intervals(interval):
    with pytest.raises(ValueError):
        P.periods_per_year(interval)


def test_inputs():
    assert P.valid_ticker(" brk.b ") == "BRK.B" and P.normalise_ticker(" brk.b ") == "BRK-B"
    assert P.valid_tickers("a, b,a") == ["A", "B", "A"]
    assert P.unique_in_order(["b", "a", "b"]) == ["b", "a"] and P.unique_in_order(["Close", "close", "Open"], fold=True) == ["Close", "Open"]
    assert P.valid_interval("5S") == "5s"
    assert P.valid_int("7", 1, 10) == 7
    for call in (lambda: P.valid_ticker("a b"), lambda: P.valid_tickers(" , "), lambda: P.valid_interval("1.5d"), lambda: P.valid_int(True, 0), lambda: P.valid_int(11, 1, 10), lambda: P.valid_metric("a-b"), lambda: P.valid_format("csv"), lambda: P.valid_columns("a;b")):
        with pytest.raises(P.ValidationError):
            call()


def test_backfill():
    assert P.full_backfill_start("1m", date(2024, 3, 8)) == date(2024, 3, 1)
    with pytest.raises(KeyError):
        P.full_backfill_start("2m", date(2024, 3, 8))


def test_errors_hide_secrets():
    try:
        try:
            raise KeyError("x")
        except KeyError as e:
            raise P.CacheError("broken", api_key="k", ticker="A") from e
    except P.CacheError as e:
        d = e.describe()
    assert d["context"] == {"api_key": P.REDACTED, "ticker": "A"} and d["code"] == "cache_error" and "KeyError" in d["causes"][0]


def test_holidays():
    days = calendar.holidays(1985, 2024)
    assert date(2024, 3, 29) in days and date(2024, 7, 4) in days and date(2021, 6, 18) in days and date(2020, 6, 19) not in days
    assert all(d in days for d in calendar.SPECIAL_CLOSURES)
    assert calendar.easter(2024) == date(2024, 3, 31) and calendar.easter(1999) == date(1999, 4, 4)
