"""Rows no round can be found for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.time import parse_time
from gapline.schema import TIME, USER, col, reject_names, require_columns
from gapline.sources.recordings import MALFORMED

REASON, RAW = "reject_reason", "_raw_time"


def tag_rejects(df: DataFrame, user_col: str = USER, ts_col: str = TIME, time_format: str | None = None) -> DataFrame:
    """Add the parsed time and ``reject_reason``; the time as it was written is kept in ``_raw_time``.

    Reasons are ``malformed line`` (of recordings read with ``malformed="keep"``), ``null user`` and
    ``malformed time``; null for a good row. An absent time is not malformed.
    """
    require_columns(df, user_col, ts_col)
    reject_names([REASON, RAW], df.columns, "input columns")
    raw, user = F.col(RAW), col(user_col)
    parsed = parse_time(df.withColumn(RAW, col(ts_col)), ts_col, strict=False, time_format=time_format)
    blank = F.trim(raw.cast("string")) == ""
    malformed = col(ts_col).isNull() & raw.isNotNull() & ~blank
    reason = F.when(user.isNull(), "null user").when(malformed, "malformed time")
    if MALFORMED in df.columns:
        reason = F.when(F.col(MALFORMED).isNotNull(), "malformed line").otherwise(reason)
    return parsed.withColumn(REASON, reason)


def good_rows(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNull()).drop(REASON, RAW, MALFORMED)


def bad_rows(tagged: DataFrame, ts_col: str = TIME) -> DataFrame:
    """The rejected rows, their time as it was written."""
    kept = [c for c in tagged.columns if c not in (RAW, REASON)]
    bad = tagged.where(F.col(REASON).isNotNull())
    return bad.select(*[(F.col(RAW) if c == ts_col else col(c)).alias(c) for c in kept], REASON)


def split_rejects(
    df: DataFrame, user_col: str = USER, ts_col: str = TIME, time_format: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into events with a user and a readable time, and the rest.

    The second table keeps the raw columns and adds ``reject_reason`` (see :func:`tag_rejects`).
    """
    tagged = tag_rejects(df, user_col, ts_col, time_format)
    return good_rows(tagged), bad_rows(tagged, ts_col)
