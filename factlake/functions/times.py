"""Time and rounding column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_ts(text: Column) -> Column:
    """``1683456789.123456`` to a timestamp, exact to the microsecond; null for other text."""
    return F.timestamp_micros((text.try_cast("decimal(20,6)") * F.lit(1000000)).cast("bigint"))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def age_text(ts: Column, now: Column) -> Column:
    """Age as whole seconds, minutes, hours or days."""
    secs = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1000000)

    def ago(size: int, unit: str) -> Column:
        return F.concat(F.floor(secs / size).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(ts.isNull(), "Never")
        .when(secs < 60, ago(1, "s"))
        .when(secs < 3600, ago(60, "m"))
        .when(secs < 86400, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one decimal, ties to even."""
    return F.bround(part.cast("double") / whole.cast("double") * 100, 1)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
