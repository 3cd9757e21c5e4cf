"""Times as whole numbers, free of any session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 00:00 on the wall clock that the value shows. A zoned timestamp
    is taken on the session's clock."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: str | Column) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def shown(us: str | Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' of microseconds."""
    return F.date_format(from_micros(us), "yyyy-MM-dd HH:mm:ss")
