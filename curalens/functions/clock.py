"""Local days and weeks of a zone, as UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_week(at: Column, zone: str) -> Column:
    """Date of the local Monday."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(at, zone)))


def week_bounds(at: Column, zone: str) -> tuple[Column, Column]:
    """Start and end of the local week as UTC instants, end exclusive."""
    monday = F.date_trunc("week", F.from_utc_timestamp(at, zone))
    return F.to_utc_timestamp(monday, zone), F.to_utc_timestamp(monday + F.expr("INTERVAL 7 DAYS"), zone)
