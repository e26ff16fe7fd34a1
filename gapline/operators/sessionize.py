"""Event-level rounds: every event with its round's number, bounds and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.time import gap_micros, parse_time
from gapline.operators.cells import CellSpec, build_cells, number_rounds
from gapline.operators.rank import with_global_rank
from gapline.schema import (
    DEFAULT_GAP_MINUTES,
    LABEL,
    ROUND_COLUMNS,
    TIME,
    USER,
    col,
    reject_names,
    require_columns,
    unused,
)


def round_id(user: Column, index: Column) -> Column:
    return F.concat(user.cast("string"), F.lit("_"), index.cast("string"))


def has_missing_times(events: DataFrame, ts_col: str) -> bool:
    """Whether any event lacks a time. Row-group statistics answer this for Parquet."""
    return not events.where(col(ts_col).isNull()).isEmpty()


def sessionize(
    df: DataFrame,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    missing_times: bool | None = None,
) -> DataFrame:
    """Events plus ``round_index, round_id, round_start, round_end, event_count``.

    A round ends when the user's next event is more than ``gap_minutes`` later;
    a distance equal to the gap stays in the round. All input columns pass through.

    Events without a user have no round and are left out: see
    :func:`gapline.split_rejects`. Events without a time come after all others of
    their user: the first one joins the last round without moving its bounds or
    count, each further one is a round of its own without bounds. Numbering them
    needs a written table, so it is done only if there are any: by default
    (``None``) the input is checked for them; pass ``False`` if there are none,
    ``True`` to skip the check.
    """
    require_columns(df, user_col, ts_col)
    reject_names(ROUND_COLUMNS, df.columns, "input columns")
    events = parse_time(df, ts_col)
    spec = CellSpec(user_col, ts_col, gap_micros(gap_minutes))
    if missing_times is None:
        missing_times = has_missing_times(events, ts_col)
    if not missing_times:
        # Prunes nothing here, but tells the planner and the Parquet reader.
        events = events.where(col(ts_col).isNotNull())

    cells = _with_bounds(number_rounds(build_cells(events, spec), spec), spec)
    timed = _attach(
        events.where(col(ts_col).isNotNull()), cells.where(F.col("cell").isNotNull()), spec
    )
    if not missing_times:
        return timed
    return timed.unionByName(_untimed(events, cells, spec))


def round_bounds(df: DataFrame, user_col: str = USER, ts_col: str = TIME) -> DataFrame:
    """One row per round of a sessionized log: start, end and number of timed events."""
    require_columns(df, user_col, ts_col, "round_id")
    ts = col(ts_col)
    return df.groupBy("round_id", col(user_col)).agg(
        F.min(ts).alias("round_start"),
        F.max(ts).alias("round_end"),
        F.count(ts).alias("event_count"),
    )


def _with_bounds(cells: DataFrame, spec: CellSpec) -> DataFrame:
    """Give every cell the bounds and size of its round."""
    keys = ["user", "round_index"]
    bounds = {
        "round_start": F.min("first_ts"),
        "round_end": F.max("last_ts"),
        "event_count": F.sum(F.when(F.col("first_ts").isNotNull(), F.col("n")).otherwise(0)),
    }
    if spec.single_task:
        # The cells already sit with their user.
        whole = Window.partitionBy(*keys)
        return cells.select(*keys, "cell", *[a.over(whole).alias(n) for n, a in bounds.items()])
    rounds = cells.groupBy(*keys).agg(*[a.alias(n) for n, a in bounds.items()])
    return cells.select(*keys, "cell").join(rounds, keys)


def _attach(events: DataFrame, cells: DataFrame, spec: CellSpec) -> DataFrame:
    """Join events to their cell's round.

    The cell side has one row per key, so a hot cell is heavy on the event side
    only, and adaptive execution splits it over tasks.
    """
    user, cell, own = (unused(c, events, cells) for c in ("_user", "_cell", "_event_cell"))
    rounds = cells.withColumnsRenamed({"user": user, "cell": cell})
    keyed = events.withColumn(own, spec.cell(events))
    on = (col(spec.user_col) == F.col(user)) & (F.col(own) == F.col(cell))
    return keyed.join(rounds, on).select(*_result(events, spec, F.col("round_index")))


def _result(events: DataFrame, spec: CellSpec, index: Column, **replaced: Column) -> list[Column]:
    made = {"round_index": index, "round_id": round_id(col(spec.user_col), index)}
    made |= replaced
    return [col(c) for c in events.columns] + [
        made.get(c, F.col(c)).alias(c) for c in ROUND_COLUMNS
    ]


def _untimed(events: DataFrame, cells: DataFrame, spec: CellSpec) -> DataFrame:
    """Number the events without a time behind their user's last round.

    They can be many and alike for one user, so they are ranked by range with a
    random last key that spreads copies; the written rank table fixes the draw.
    """
    user = col(spec.user_col)
    label = [F.col(LABEL)] if LABEL in events.columns else []
    loose = events.where(col(spec.ts_col).isNull() & user.isNotNull())
    rank, first_rank, owner = (unused(c, events, cells) for c in ("_rank", "_first", "_user"))
    ranked, _ = with_global_rank(loose, [user, *label, F.rand(seed=7)], rank)
    first = ranked.groupBy(user.alias(owner)).agg(F.min(rank).alias(first_rank))
    last = (
        cells.where(F.col("cell").isNull())
        .drop("cell")
        .withColumnRenamed("user", owner)
        .join(first, owner)
    )
    extra = F.col(rank) - F.col(first_rank)
    joins = extra == 0
    return ranked.join(last, user == F.col(owner)).select(
        *_result(
            events,
            spec,
            F.col("round_index") + extra,
            round_start=F.when(joins, F.col("round_start")),
            round_end=F.when(joins, F.col("round_end")),
            event_count=F.when(joins, F.col("event_count")).otherwise(F.lit(0)),
        )
    )
