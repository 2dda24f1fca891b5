"""Display forms of byte counts, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB"]


def _scaled(size: Column, rounding) -> Column:
    number = size.cast("double")

    def by_unit(values: list) -> Column:
        return (
            F.when(number < 2**20, F.lit(values[0]))
            .when(number < 2**30, F.lit(values[1]))
            .when(number < 2**40, F.lit(values[2]))
            .otherwise(F.lit(values[3]))
        )

    # A double with one decimal below ten million prints as it is; formatting per row would cost far more.
    shown = rounding(number / by_unit([2.0**10, 2.0**20, 2.0**30, 2.0**40])).cast("string")
    return (
        F.when(number.isNull() | (number < 0), F.lit(None).cast("string"))
        .when(number < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .otherwise(F.concat(shown, by_unit([f" {unit}" for unit in UNITS[1:]])))
    )


def format_size(size: Column) -> Column:
    """``1536 -> '1.5 KB'``; null and negative give null.  Ties in the decimal go to the even digit.

    ``size`` is read many times: pass a column, not a long expression.
    """
    return _scaled(size, lambda x: F.bround(x, 1))


def format_size_ui(size: Column) -> Column:
    """As :func:`format_size`, with ties rounded up, the way the browser shows sizes."""
    return _scaled(size, lambda x: F.round(x, 1))


def format_size_history(size: Column) -> Column:
    """The history page's variant: missing and zero sizes read ``0 B``."""
    return F.when(size.isNull() | (size == 0), F.lit("0 B")).otherwise(format_size_ui(size))


def _clock(seconds: Column, drop_zero_seconds: bool) -> Column:
    def whole(value: Column) -> Column:
        return F.floor(value).cast("bigint").cast("string")

    def nearest(value: Column) -> Column:
        return whole(value + F.lit(0.5))

    minutes = whole(seconds / 60)
    rest = nearest(seconds % 60)
    with_seconds = F.concat(minutes, F.lit("m "), rest, F.lit("s"))
    if drop_zero_seconds:
        with_seconds = F.when(rest == "0", F.concat(minutes, F.lit("m"))).otherwise(with_seconds)
    return (
        F.when(seconds < 60, F.concat(nearest(seconds), F.lit("s")))
        .when(seconds < 3600, with_seconds)
        .otherwise(F.concat(whole(seconds / 3600), F.lit("h "), nearest((seconds % 3600) / 60), F.lit("m")))
    )


def format_duration(seconds: Column) -> Column:
    """Elapsed time of a finished scan; zero seconds after whole minutes are left out."""
    return F.when(seconds.isNotNull(), _clock(seconds.cast("double"), True))


def format_eta(seconds: Column) -> Column:
    """Remaining time of a running scan."""
    value = seconds.cast("double")
    unusable = value.isNull() | (value <= 0) | F.isnan(value) | (value == float("inf"))
    return F.when(unusable, F.lit("Calculating...")).otherwise(_clock(value, False))


def eta_seconds(done: Column, remaining: Column, elapsed: Column) -> Column:
    """Remaining seconds at the pace so far; null while nothing is done."""
    pace = F.when(done > 0, F.try_divide(done.cast("double"), elapsed.cast("double")))
    return F.when(pace > 0, remaining.cast("double") / pace)


def duration_seconds(start: Column, end: Column) -> Column:
    """``end - start`` in seconds, null when either is missing."""
    return end.cast("double") - start.cast("double")


def rate_delay(requests_per_second: Column) -> Column:
    return F.lit(1.0) / requests_per_second


def relative_day(moment: Column, as_of: Column) -> Column:
    """``Today 09:30``, ``Yesterday 18:05``, else ``Mar 4 11:00``, relative to an explicit ``as_of``."""
    days = F.datediff(as_of, moment)
    time = F.date_format(moment, "HH:mm")
    day = F.when(days == 0, F.lit("Today")).when(days == 1, F.lit("Yesterday"))
    return F.concat(F.coalesce(day, F.date_format(moment, "MMM d")), F.lit(" "), time)
