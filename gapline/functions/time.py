"""Timestamp parsing and elapsed time that no time zone can bend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.schema import col
MICROS = 1_000_000
_DAY_MICROS = 86_400 * MICROS
_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def gap_micros(gap_minutes: float) -> int:
    """Gap in whole microseconds.

    Timestamps are whole microseconds, so rounding down (from nanoseconds)
    cannot change the outcome of ``difference > gap``.
    """
    if gap_minutes < 0:
        raise ValueError("gap_minutes must not be negative")
    return round(gap_minutes * 60 * 1000 * MICROS) // 1000


def parse_time(df: DataFrame, ts_col: str, strict: bool = True, time_format: str | None = None) -> DataFrame:
    """Make ``ts_col`` a timestamp.

    Strings are read as ISO timestamps, with an offset (normalised to the
    instant) or without (taken in the session time zone). Integers are
    nanoseconds since the epoch. Blank strings are null. A string that is no
    timestamp raises; with ``strict=False`` it becomes null. ``time_format`` is a
    pattern of Spark's (``MM/dd/yyyy HH:mm``) for strings that are not ISO; none is guessed.
    """
    dtype = df.schema[ts_col].dataType
    raw = col(ts_col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(dtype, T.DateType):
        return df.withColumn(ts_col, raw.cast("timestamp"))
    if isinstance(dtype, T.IntegralType):
        nanos = raw.cast("bigint")
        micros = F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))
        return df.withColumn(ts_col, F.timestamp_micros(micros))
    if not isinstance(dtype, T.StringType):
        raise TypeError(f"{ts_col} has type {dtype.simpleString()}, not a timestamp or string")
    text = F.nullif(F.trim(raw), F.lit(""))
    parsed = F.try_to_timestamp(text, F.lit(time_format)) if time_format else F.try_to_timestamp(text)
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"{ts_col} is not a timestamp: "), text))
        parsed = F.when(parsed.isNull() & text.isNotNull(), bad.cast("timestamp")).otherwise(parsed)
    return df.withColumn(ts_col, parsed)


def epoch_micros(df: DataFrame, ts: Column | str, like: str | None = None) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone.

    The kind of timestamp is taken from column ``like`` of ``df`` (default: ``ts``).
    """
    time = col(ts) if isinstance(ts, str) else ts
    dtype = df.schema[like or ts].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(time)
    if not isinstance(dtype, T.TimestampNTZType):
        raise TypeError(f"expected a timestamp, got {dtype.simpleString()}")
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return F.unix_micros(time.cast("timestamp"))
    # A cast would go through the session zone and lose the hour a clock change
    # skips, so count days and time of day instead.
    second = (F.extract(F.lit("SECOND"), time) * MICROS).cast("bigint")
    clock = (F.hour(time) * 3600 + F.minute(time) * 60).cast("bigint") * F.lit(MICROS)
    return F.unix_date(time.cast("date")).cast("bigint") * F.lit(_DAY_MICROS) + clock + second


def elapsed_seconds(
    df: DataFrame, end: Column | str, start: Column | str, like: str | None = None
) -> Column:
    """Seconds from ``start`` to ``end`` as a double."""
    return (epoch_micros(df, end, like) - epoch_micros(df, start, like)) / F.lit(float(MICROS))
