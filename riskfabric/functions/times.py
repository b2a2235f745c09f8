"""Time parsing and ages against an explicit reference time."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL when it cannot be parsed."""
    return F.try_to_timestamp(text)


def first_time(*candidates) -> Column:
    """First usable timestamp; text columns are parsed, others passed through."""
    return F.coalesce(*candidates)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds (with fraction) between two timestamps."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def age_days(as_of: Column, moment: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(as_of, moment) / 86400)


def age_hours(as_of: Column, moment: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(as_of, moment) / 3600)


def age_minutes(as_of: Column, moment: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(as_of, moment) / 60)


def as_of_column(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def duration_text(minutes: Column) -> Column:
    """``Hh MMm`` or ``Mm``."""
    whole = minutes.cast("bigint")
    hours, rest = F.floor(whole / 60), F.pmod(whole, F.lit(60))
    return (F.when(minutes.isNull(), F.lit("Unavailable"))
             .when(hours > 0, F.format_string("%dh %02dm", hours, rest))
             .otherwise(F.format_string("%dm", rest)))
