"""Column expressions shared by the operators: ages, day gaps, seeded order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the approximate calendar: days per year and per month.
YEAR_DAYS = 365
MONTH_DAYS = 30


def _calendar_gap(later: Column, earlier: Column, day_term: Column) -> Column:
    years = F.year(later) - F.year(earlier)
    months = F.month(later) - F.month(earlier)
    return years * F.lit(YEAR_DAYS) + months * F.lit(MONTH_DAYS) + day_term


def days_approx(later: Column, earlier: Column, variant: str = "day") -> Column:
    """Days from ``earlier`` to ``later``.

    ``day``              365-day years, 30-day months, difference of days of month.
    ``day_minus_month``  the same, but the day term is day(later) - month(earlier).
    ``exact``            real calendar days.
    """
    if variant == "day":
        return _calendar_gap(later, earlier, F.dayofmonth(later) - F.dayofmonth(earlier))
    if variant == "day_minus_month":
        return _calendar_gap(later, earlier, F.dayofmonth(later) - F.month(earlier))
    if variant == "exact":
        return F.datediff(later, earlier)
    raise ValueError(f"unknown day variant {variant!r}")


def age_years(at: Column, birth: Column) -> Column:
    """Approximate age in whole years; the division truncates toward zero."""
    return F.call_function("div", days_approx(at, birth), F.lit(YEAR_DAYS)).cast("int")


def hash_order(key: Column, seed: int) -> Column:
    """Seeded random order: the same digest in any engine, so a draw can be repeated."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_bucket(order_key: Column, digits: int = 3) -> Column:
    """Leading hex digits of a ``hash_order`` key: even buckets in the key's own order."""
    return F.substring(order_key, 1, digits)


def is_true(predicate: Column) -> Column:
    """TRUE only where the predicate is TRUE; FALSE where it is FALSE or NULL."""
    return F.coalesce(predicate, F.lit(False))


def year_window(day: Column, first_year: int, last_year: int) -> Column:
    """``year(day) between first and last`` as a plain range, which reaches the file scan."""
    return (day >= F.lit(f"{first_year}-01-01").cast("date")) & (
        day < F.lit(f"{last_year + 1}-01-01").cast("date")
    )


def safe_name(code: str) -> str:
    """A code as part of a column name: anything but letters, digits and _ becomes _."""
    return "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in code)
