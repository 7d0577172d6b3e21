"""Column functions on numbers, dates and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candidata.functions.binding import bind

# The units sizes are shown in.
SIZE_UNITS = ("Bytes", "KB", "MB", "GB")

NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def parse_percent(c: Column) -> Column:
    """The number a text starts with, else 0."""
    number = F.regexp_extract(c.cast("string"), NUMBER, 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def human_bytes(c: Column) -> Column:
    """`1.5 KB`: at most two decimals, the largest unit that is not above the size."""
    size = c.cast("double")
    shown = F.lit(None).cast("string")
    for power in reversed(range(len(SIZE_UNITS))):
        number = F.round(size / float(1024**power), 2).cast("decimal(30,2)").cast("string")
        text = F.concat(
            F.regexp_replace(number, r"\.?0+$", ""), F.lit(" " + SIZE_UNITS[power])
        )
        shown = F.coalesce(shown, F.when(size >= float(1024**power), text))
    return F.when(c == 0, F.lit("0 Bytes")).otherwise(shown)


def fit_band(c: Column) -> Column:
    """Lower end of the quarter a percentage falls in; upper ends are inclusive."""
    return F.when(c <= 25, 0).when(c <= 50, 25).when(c <= 75, 50).otherwise(75)


def day_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _month(year: Column, month: Column, year_only_month: int) -> Column:
    number = F.coalesce(month.try_cast("int"), F.lit(year_only_month))
    return F.when(number.between(1, 12), F.make_date(year.try_cast("int"), number, F.lit(1)))


def parse_period(c: Column, as_of: Column) -> Column:
    """`MM/YYYY - MM/YYYY`, `YYYY - Present` or one date, as first days of months.

    A year alone starts in January and ends in December. `as_of` stands for an end
    that is still open.
    """
    date = r"(?:(\d{1,2})/)?(\d{4})"
    first = r"^\s*" + date + r"(?:\s+-\s|\s*$)"
    last = r"(?:^|\s-\s)\s*" + date + r"\s*$"
    start = _month(F.regexp_extract(c, first, 2), F.regexp_extract(c, first, 1), 1)
    end = _month(F.regexp_extract(c, last, 2), F.regexp_extract(c, last, 1), 12)
    is_open = c.rlike(r"(?i)(?:^|\s-\s)\s*(?:present|current|now)\s*$")
    return F.struct(
        start.alias("start"),
        F.when(is_open, F.trunc(as_of.cast("date"), "month")).otherwise(end).alias("end"),
    )


def experience_years(experience: Column, as_of: Column) -> Column:
    """Years from the first start to the last end of a list of positions; null without dates."""

    def span(periods: Column) -> Column:
        first = F.array_min(F.transform(periods, lambda p: p["start"]))
        last = F.array_max(F.transform(periods, lambda p: p["end"]))
        return F.datediff(last, first) / 365.25

    return bind(F.transform(experience, lambda e: parse_period(e["duration"], as_of)), span)
