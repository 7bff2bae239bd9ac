"""Date columns from raw text, windows of dates, validity ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import _col

US_DATE = "M/d/yyyy"


def parse_date(raw: str | Column, fmt: str = US_DATE) -> Column:
    """Null where the text isn't such a date; never an error."""
    return F.to_date(F.try_to_timestamp(_col(raw), F.lit(fmt)))


def raw_and_parsed(raw: str | Column, name: str, fmt: str = US_DATE) -> list[Column]:
    """The text as it came beside the date read from it: <name>_raw, <name>_date."""
    return [_col(raw).alias(f"{name}_raw"), parse_date(raw, fmt).alias(f"{name}_date")]


def format_date(date: str | Column, fmt: str = US_DATE) -> Column:
    return F.date_format(_col(date), fmt)


def in_window(date: str | Column, start: str | None = None, end: str | None = None) -> Column:
    """Both bounds belong to the window and either may be open; unknown dates are only in the unbounded window."""
    date, test = _col(date), F.lit(True)
    if start is not None:
        test = test & (date >= F.lit(start).cast("date"))
    if end is not None:
        test = test & (date <= F.lit(end).cast("date"))
    return F.coalesce(test, F.lit(False)) if start or end else test


def in_year(date: str | Column, year: int) -> Column:
    """As a range, so that it prunes partitions and row groups."""
    return (_col(date) >= F.lit(f"{year}-01-01").cast("date")) & (_col(date) < F.lit(f"{year + 1}-01-01").cast("date"))


def weekly_slices(bounds: DataFrame, start: str = "start", end: str = "end", days: int = 7) -> DataFrame:
    """Each row's span as consecutive slices of ``days``; the last one ends with the span."""
    first = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {days} DAYS")))
    sliced = bounds.where(F.col(start) <= F.col(end)).withColumn("slice_start", first)
    return sliced.withColumn("slice_end", F.least(F.date_add("slice_start", days - 1), F.col(end)))


def open_end(end: str | Column, horizon: str) -> Column:
    """An end beyond the horizon means that there is none."""
    return F.when(_col(end) <= F.lit(horizon).cast("date"), _col(end))
