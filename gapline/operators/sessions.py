"""Rounds through Spark's session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.time import MICROS, epoch_micros, gap_micros, parse_time
from gapline.operators.cells import CellSpec, build_cells
from gapline.operators.features import features_from_cells
from gapline.schema import DEFAULT_GAP_MINUTES, TIME, USER, col, require_columns


def session_rounds(
    df: DataFrame,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
) -> DataFrame:
    """``user, round_start, round_end, event_count`` per round, unnumbered.

    The batch form of the streaming aggregate. A session window over events
    would bring all events of a user to one task, so it runs over cells: a cell
    from ``first`` to ``last`` is one session of length ``last - first + gap``.
    Gaps under a minute leave too many cells per user for one task and are
    numbered instead. Events without a user or a time are left out.
    """
    require_columns(df, user_col, ts_col)
    gap = gap_micros(gap_minutes)
    if gap == 0:
        raise ValueError("a session window needs a positive gap")
    events = parse_time(df, ts_col)
    spec = CellSpec(user_col, ts_col, gap)
    cells = build_cells(events.where(col(ts_col).isNotNull()), spec)
    if not spec.single_task:
        rounds = features_from_cells(cells, spec, {})
        return rounds.select(col(user_col), "round_start", "round_end", "event_count")
    length = epoch_micros(cells, "last_ts") - epoch_micros(cells, "first_ts") + F.lit(gap)
    seconds = (length.cast("decimal(18,0)") / MICROS).cast("decimal(18,6)")
    return (
        cells.groupBy("user", F.session_window("first_ts", F.make_interval(secs=seconds)))
        .agg(
            F.min("first_ts").alias("round_start"),
            F.max("last_ts").alias("round_end"),
            F.sum("n").alias("event_count"),
        )
        .select(F.col("user").alias(user_col), "round_start", "round_end", "event_count")
    )
