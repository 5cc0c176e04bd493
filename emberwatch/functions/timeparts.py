"""Event time: durations, epoch numbers and readable clock times."""

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: microseconds per unit
UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}

def micros(duration: str) -> int:
    """Microseconds in a duration such as `10 minutes` or `1 day 6 hours`."""
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?\b", duration.strip().lower())
    left_over = re.sub(r"(\d+)\s+([a-z]+?)s?\b", "", duration.strip().lower()).strip()
    if not parts or left_over or any(unit not in UNIT_MICROS for _, unit in parts):
        raise ValueError(f"not a fixed duration: {duration!r}")
    return sum(int(number) * UNIT_MICROS[unit] for number, unit in parts)


def event_time(df: DataFrame, column: str = "timestamp", unit: str = "s") -> DataFrame:
    """Turn an epoch number column into a timestamp; `unit` is `s` or `ms`."""
    converters = {"s": F.timestamp_seconds, "ms": F.timestamp_millis}
    if unit not in converters:
        raise ValueError(f"unit must be 's' or 'ms', not {unit!r}")
    return df.withColumn(column, converters[unit](F.col(column)))


def readable_time(when: Column, zone: str = "Asia/Kathmandu", pattern: str = "HH:mm:ss") -> Column:
    """Clock time of an instant in `zone`, whatever the session's zone is.

    The instant's own microseconds are used: the session's wall clock shows the hour that
    the clocks go back twice.
    """
    utc = from_micros(F.unix_micros(when.cast("timestamp")), ntz=True)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.date_format(local, pattern)


def is_ntz(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.TimestampNTZType)


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def as_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a timestamp without zone keeps its wall clock."""
    if not is_ntz(df, column):
        return F.unix_micros(F.col(column))
    since = (F.col(column) - _epoch()).cast("interval second").cast("decimal(18,6)")
    return (since * UNIT_MICROS["second"]).cast("long")


def from_micros(us: Column, ntz: bool) -> Column:
    """The reverse of `as_micros`."""
    if not ntz:
        return F.timestamp_micros(us)
    seconds = (us.cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def watermarked(df: DataFrame, column: str, delay: str) -> DataFrame:
    """The same rows; on a stream also a watermark, which needs a zoned timestamp."""
    if not df.isStreaming:
        return df
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def kept_for(late: str, retention: str) -> int:
    """Microseconds the watermark stays behind the clock, so that late rows still come."""
    if late not in ("dropped", "taken"):
        raise ValueError(f"late must be 'dropped' or 'taken', not {late!r}")
    return micros(retention) if late == "taken" else 0


def behind_clock(df: DataFrame, column: str, delay: str, behind: int) -> DataFrame:
    """A watermark `delay` and so many microseconds behind the greatest event time."""
    return watermarked(df, column, f"{(micros(delay) + behind) // 1000} milliseconds")
