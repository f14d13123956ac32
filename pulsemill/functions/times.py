"""Instants from text. The session zone must be UTC (see session.use_utc)."""

from pyspark.sql import Column, functions as F

_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?)"


def _read(c: Column) -> Column:
    # Spark wants seconds before a zone.
    return F.try_to_timestamp(
        F.regexp_replace(c, f"^({_DAY}[T ]\\d{{2}}:\\d{{2}})({_ZONE}?)$", "$1:00$2")
    )


def parse_instant(c: Column) -> Column:
    """ISO 8601 with a zone to TIMESTAMP; anything else NULL.

    The gate matters: Spark alone would read "2026" as a year and "17:05" as today.
    """
    return F.when(c.rlike(f"^{_DAY}[T ]{_CLOCK}{_ZONE}$"), _read(c))


def coerce_instant(c: Column) -> Column:
    """Like parse_instant, but a text without zone or clock is taken as UTC."""
    return F.when(c.rlike(f"^{_DAY}([T ]{_CLOCK}{_ZONE}?)?$"), _read(c))


def date_key(ts: Column) -> Column:
    return F.to_date(ts)


def hour_start(ts: Column) -> Column:
    """Start of the UTC hour as a zone-free timestamp."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")
