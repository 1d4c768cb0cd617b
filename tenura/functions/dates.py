"""Calendar arithmetic on timestamps (sessions run in UTC)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def month_of(ts) -> Column:
    """First day of the month, as a date."""
    return F.trunc(F.to_date(ts), "MM")


def month_label(month) -> Column:
    return F.date_format(month, "yyyy-MM")


def months_between(start: Column, end: Column) -> Column:
    """Calendar months from one date to another, ignoring the day."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed 24-hour days, rounded towards minus infinity.

    ``datediff`` counts midnights and ``timestampdiff`` truncates towards
    zero, so neither fits a span that may be negative.
    """
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.call_function("div", micros - F.pmod(micros, F.lit(DAY_MICROS)), F.lit(DAY_MICROS))


def timestamp_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
