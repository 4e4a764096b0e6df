"""Column helpers for instants; "now" is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from servertide.functions.numbers import div


def instant(value: datetime | str | Column) -> Column:
    """A zone-less timestamp, as collected telemetry has them."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def days_between(earlier: Column, later: Column) -> Column:
    """DATEDIFF(day): midnights passed, not full days."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def seconds_between(earlier: Column, later: Column) -> Column:
    """DATEDIFF(second): second boundaries passed."""
    return F.timestamp_diff("SECOND", F.date_trunc("SECOND", earlier), F.date_trunc("SECOND", later))


def day_first(column: Column) -> Column:
    return F.date_format(column, "dd/MM/yyyy HH:mm:ss")


def plus_seconds(column: Column, seconds: Column) -> Column:
    whole = seconds.cast("long")
    return column + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)"))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``'h hour(s), mmin, s sec'``."""
    return F.concat(
        div(seconds, 3600).cast("string"), F.lit(" hour(s), "),
        div(seconds % 3600, 60).cast("string"), F.lit("min, "),
        (seconds % 60).cast("string"), F.lit(" sec"),
    )
