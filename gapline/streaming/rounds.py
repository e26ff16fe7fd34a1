"""Rounds from arriving recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gapline.functions.time import epoch_micros, gap_micros, parse_time
from gapline.operators.cells import CellSpec
from gapline.operators.features import features_from_cells, label_counts
from gapline.schema import (
    DEFAULT_GAP_MINUTES,
    FEATURE_COLUMNS,
    TIME,
    USER,
    col,
    reject_names,
    require_columns,
)
from gapline.sources.recordings import recordings_stream

POLL_INTERVAL = "60 seconds"
# Merges the events of a round on the mapper, before the shuffle by user.
_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def closed_rounds(
    events: DataFrame,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    delay_minutes: float = 10,
    labels: list[str] | None = None,
) -> DataFrame:
    """Streaming aggregate: one row per round that can no longer grow.

    Columns: user, ``round_start, round_end, event_count`` and one count per
    label. Times without a zone are taken as UTC instants, whatever the session's zone. Rows without a user or a readable time are counted in the query
    progress (observed metric ``rejects``) and left out.
    """
    require_columns(events, user_col, ts_col)
    gap = gap_micros(gap_minutes)
    if gap == 0:
        raise ValueError("a stream needs a positive gap")
    labels = list(labels or [])
    reject_names(labels, [user_col, *FEATURE_COLUMNS], "labels")
    user, ts = col(user_col), col(ts_col)
    timed = parse_time(events, ts_col, strict=False)
    # A cast would take times without a zone in the session's zone, and bend them at clock changes.
    instant = F.timestamp_micros(epoch_micros(timed, ts_col))
    timed = timed.withColumn(ts_col, instant)
    usable = timed.observe(
        "rejects",
        F.count_if(user.isNull()).alias("null_user"),
        F.count_if(user.isNotNull() & ts.isNull()).alias("no_time"),
    ).where(user.isNotNull() & ts.isNotNull())
    return (
        usable.withWatermark(ts_col, f"{gap_micros(delay_minutes)} microseconds")
        .groupBy(user, F.session_window(ts, f"{gap} microseconds"))
        .agg(
            F.min(ts).alias("round_start"),
            F.max(ts).alias("round_end"),
            F.count(ts).alias("event_count"),
            *label_counts(usable, labels),
        )
        .drop("session_window")
    )


def stream_rounds(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    out: str,
    checkpoint: str,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    delay_minutes: float = 10,
    labels: list[str] | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    poll: str | None = None,
) -> StreamingQuery:
    """Start a query that appends closed rounds to Parquet at ``out``.

    Files that appear under ``source`` are taken up once; CSV files follow the rules of
    :func:`gapline.read_recordings`, and a line or header that does not fit fails the query. A round is closed when
    the watermark (latest time seen less ``delay_minutes``) has passed its last
    event by the gap; rounds still open stay in the state. Events later than
    that are dropped: the batch job over the whole log remains the truth.

    Without ``poll`` the query takes what is there and stops; with it (for
    example ``POLL_INTERVAL``) it keeps looking. ``options`` go to the source;
    give ``maxFilesPerTrigger`` to take a long backlog in bounded steps. ``out``
    and ``checkpoint`` must be in storage that all executors share.
    """
    events = recordings_stream(spark, source, schema, fmt, options)
    rounds = closed_rounds(events, user_col, ts_col, gap_minutes, delay_minutes, labels)
    writer = (
        rounds.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    before = spark.conf.get(_LOCAL_MERGE)
    spark.conf.set(_LOCAL_MERGE, "true")
    try:
        return writer.start()  # the query keeps a copy of the settings
    finally:
        spark.conf.set(_LOCAL_MERGE, before)


def index_closed_rounds(
    closed: DataFrame,
    user_col: str = USER,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    labels: list[str] | None = None,
) -> DataFrame:
    """Feature rows from the closed rounds a stream has written so far.

    A stream cannot know a round's number or distance to the one before without
    keeping every earlier round, so both are found here. A late event that was
    let through within the gap of a round already written arrives as a round of
    its own; it is merged with its neighbour again.
    """
    require_columns(closed, user_col, "round_start", "round_end", "event_count")
    labels = list(labels or [])
    reject_names(labels, [user_col, *FEATURE_COLUMNS], "labels")
    spec = CellSpec(user_col, "round_start", gap_micros(gap_minutes))
    cells = closed.where(col(user_col).isNotNull()).select(
        col(user_col).alias("user"),
        epoch_micros(closed, "round_start").alias("cell"),
        F.col("round_start").alias("first_ts"),
        F.col("round_end").alias("last_ts"),
        F.col("event_count").alias("n"),
        *[col(v).alias(f"closed_{i}") for i, v in enumerate(labels)],
    )
    counts = {v: F.col(f"closed_{i}") for i, v in enumerate(labels)}
    return features_from_cells(cells, spec, counts)
