"""Reference time, trailing windows and rounding.

``as_of`` stands for "now". It is a value, a Column, or None; None means the latest time in the
table itself, read as a scalar subquery inside the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.schemas import DAY, LOG_TIME

_UNITS = {"minutes": "MINUTES", "hours": "HOURS", "days": "DAYS", "months": "MONTHS"}


def as_of_column(as_of, df: DataFrame, time_col: str) -> Column:
    if as_of is None:
        return df.select(F.max(time_col)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def interval(n: int, unit: str) -> Column:
    return F.expr(f"INTERVAL {int(n)} {_UNITS[unit]}")


def within(df: DataFrame, time_col: str, as_of=None, n: int = 30, unit: str = "days",
           closed: bool = False, as_of_from: str | None = None) -> DataFrame:
    """Rows of the trailing window; ``closed`` keeps the edge itself.

    ``as_of_from`` names the column whose maximum is "now" when it is not ``time_col``.
    """
    start = before(as_of, df, as_of_from or time_col, n, unit)
    col = F.col(time_col)
    return since_day(df, time_col, start).filter(col >= start if closed else col > start)


def since_day(df: DataFrame, time_col: str, start: Column, nulls: bool = False) -> DataFrame:
    """Cut a log in day folders (column ``day``) to the folders from the day of ``start`` on.

    Only where the folders go by ``time_col``, the log's own time. ``nulls`` keeps rows without day.
    """
    if DAY not in df.columns or time_col not in set(LOG_TIME.values()):
        return df
    recent = F.col(DAY) >= F.to_date(start)
    return df.filter(recent | F.col(DAY).isNull() if nulls else recent)


def before(as_of, df: DataFrame, time_col: str, n: int, unit: str) -> Column:
    """The time ``n`` units before "now", ready to compare: the scan can use it to skip data."""
    if as_of is None:
        return df.select(F.max(time_col) - interval(n, unit)).scalar()
    return as_of_column(as_of, df, time_col) - interval(n, unit)


def micros_between(later: Column, earlier: Column) -> Column:
    stamp = lambda c: F.unix_micros(c.cast("timestamp"))
    return stamp(later) - stamp(earlier)


def hours_between(later: Column, earlier: Column) -> Column:
    return micros_between(later, earlier) / F.lit(1000000.0) / F.lit(3600.0)


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent of ``whole``; an empty whole gives 0. Rounds half to even."""
    return F.bround(part / F.greatest(whole, F.lit(1)) * 100, digits)
