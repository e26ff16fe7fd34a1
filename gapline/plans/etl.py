"""File of recordings to feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions.time import parse_time
from gapline.operators.features import round_features
from gapline.schema import DEFAULT_GAP_MINUTES, TIME, USER, col, require_columns
from gapline.sources.recordings import read_features, read_recordings, write_features
from gapline.sources.rejects import REASON, bad_rows, good_rows, tag_rejects
from gapline.sources.scratch import cleared, exists


def run_etl(
    spark: SparkSession,
    source: str | list[str],
    out: str,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    schema: T.StructType | str | None = None,
    rejects: str | None = None,
    fmt: str = "csv",
    labels: list[str] | None = None,
    missing_times: bool | None = None,
    mode: str = "overwrite",
    time_format: str | None = None,
) -> DataFrame:
    """Read recordings, compute round features, write them and read them back.

    A null user or a malformed time fails the run, unless ``rejects`` names a
    path to write such rows to. ``mode='ignore'`` skips the run if ``out``
    exists. A CSV source is parsed once, if its ``schema`` is given, and once more for
    ``rejects`` if there are any; lines that do not fit the schema go there as well. ``time_format`` reads
    times that are not ISO (see :func:`gapline.parse_time`). Tables written on the way are deleted.
    """
    if mode == "ignore":
        if exists(spark, out):
            return read_features(spark, out)
    events = read_recordings(spark, source, schema, fmt, malformed="keep" if rejects else "fail")
    require_columns(events, user_col, ts_col)
    unknown = labels is None or missing_times is None
    once = unknown and fmt == "csv"
    tagged, seen = None, Observation("rejects")
    if rejects:
        tagged = tag_rejects(events, user_col, ts_col, time_format)
        # The one scan of a CSV source counts its rejects on the way.
        counting = tagged.observe(seen, F.count(REASON).alias("rows")) if once else tagged
        events = good_rows(counting)
    else:
        user = col(user_col)
        failed = F.raise_error(F.lit(f"{user_col} is null; give a rejects path to set such rows aside"))
        checked = F.coalesce(user, failed.cast(events.schema[user_col].dataType))
        events = parse_time(events.withColumn(user_col, checked), ts_col, time_format=time_format)
    with cleared(spark):
        features = round_features(
            events,
            user_col,
            ts_col,
            gap_minutes,
            labels=labels,
            missing_times=missing_times,
            single_scan=once,
        )
        write_features(features, out, mode=mode)
    if rejects:
        bad = bad_rows(tagged, ts_col)
        bad = bad.limit(0) if once and not seen.get["rows"] else bad
        bad.write.mode(mode).parquet(rejects)
    return read_features(spark, out)
