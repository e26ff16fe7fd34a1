"""Round numbering on pre-aggregated time cells.

A cell is ``(user, floor(time / width))`` with ``width = gap + 1`` microseconds.
Two events of one cell are at most ``gap`` apart, so they always belong to the
same round, and a round can only start at the first event of a cell. Rounds are
therefore found exactly from one row per non-empty cell: its first time, its
last time and its counts.

Cells are sums, minima and maxima, so they are combined on the map side before
anything is shuffled. A user who owns a third of all events, or a timestamp
shared by a third of all events, shrinks to its cells on every mapper. What is
left of one user is bounded by the clock, not by the number of rows: at most
``time span / gap`` cells, 17,520 a year at a gap of 30 minutes.

Gaps under a minute would make that bound loose, so there the cells of one user
are cut further into chunks of time. Only one row per chunk is then brought
together per user, again at most one per minute of log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gapline.schema import col
from gapline.functions.time import MICROS, epoch_micros

# A user's cells go through one task only if the gap bounds them to one a minute.
SINGLE_TASK_GAP_MICROS = 60 * MICROS
_CHUNK_CELLS = 50_000
_CHUNK_MICROS = 60 * MICROS


@dataclass(frozen=True)
class CellSpec:
    """How events of one log fall into cells."""

    user_col: str
    ts_col: str
    gap: int  # microseconds

    @property
    def width(self) -> int:
        return self.gap + 1

    @property
    def chunk_width(self) -> int:
        """Width of a chunk, a whole number of cells."""
        return self.width * max(_CHUNK_CELLS, -(-_CHUNK_MICROS // self.width))

    @property
    def single_task(self) -> bool:
        return self.gap >= SINGLE_TASK_GAP_MICROS

    def cell(self, df: DataFrame) -> Column:
        """Start of the event's cell in microseconds; null without a time."""
        micros = epoch_micros(df, self.ts_col)
        return micros - F.pmod(micros, F.lit(self.width))


def build_cells(events: DataFrame, spec: CellSpec, split_by: Column | None = None) -> DataFrame:
    """One row per non-empty cell: ``user, cell, first_ts, last_ts, n``.

    Events without a user are left out. Events without a time form one cell of
    their own (``cell`` and times null) per user. ``split_by`` splits each cell by
    one more column, ``label``: rows stay narrow however many labels there are.
    """
    ts = col(spec.ts_col)
    return (
        events.where(col(spec.user_col).isNotNull())
        .groupBy(
            col(spec.user_col).alias("user"),
            spec.cell(events).alias("cell"),
            *([] if split_by is None else [split_by.alias("label")]),
        )
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    )


def number_rounds(cells: DataFrame, spec: CellSpec) -> DataFrame:
    """Add ``round_index``, ``opens`` (first row of its round) and ``prev_ts``.

    ``prev_ts`` is the user's latest time before the row, so on an opening row it
    is the end of the previous round. Rows without a time come last and join the
    user's last round, or open one if there is none. Split cells need no care:
    in order of ``first_ts`` the rows of a cell follow each other, and only the
    earliest can open a round.
    """
    return _number_by_user(cells, spec) if spec.single_task else _number_by_chunk(cells, spec)


def _too_far(cells: DataFrame, spec: CellSpec, first_ts: Column, prev_ts: Column) -> Column:
    distance = epoch_micros(cells, first_ts, "first_ts") - epoch_micros(cells, prev_ts, "first_ts")
    return F.coalesce(distance > F.lit(spec.gap), F.lit(False))


def _in_time(*keys: str) -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    """A window in time order, its rows so far, and its rows before."""
    in_time = Window.partitionBy(*keys).orderBy(F.col("first_ts").asc_nulls_last())
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return in_time, so_far, in_time.rowsBetween(Window.unboundedPreceding, -1)


def _number_by_user(cells: DataFrame, spec: CellSpec) -> DataFrame:
    in_time, so_far, before = _in_time("user")
    first_ts, prev_ts = F.col("first_ts"), F.col("prev_ts")
    seen = cells.withColumns(
        {"prev_ts": F.max("last_ts").over(before), "position": F.row_number().over(in_time)}
    )
    opens = (F.col("position") == 1) | _too_far(cells, spec, first_ts, prev_ts)
    index = F.sum(F.col("opens").cast("bigint")).over(so_far)
    return seen.select(*cells.columns, "prev_ts", opens.alias("opens")).withColumn("round_index", index)


def _number_by_chunk(cells: DataFrame, spec: CellSpec) -> DataFrame:
    # The largest chunk number stands for cells without a time, so they stay last.
    chunk = F.coalesce(
        F.col("cell") - F.pmod(F.col("cell"), F.lit(spec.chunk_width)), F.lit(2**63 - 1)
    )
    in_time, so_far, before = _in_time("user", "chunk")
    local = cells.withColumn("chunk", chunk).withColumns(
        {"local_prev": F.max("last_ts").over(before), "position": F.row_number().over(in_time)}
    )
    inner = (F.col("position") > 1) & _too_far(cells, spec, F.col("first_ts"), F.col("local_prev"))
    local = local.withColumn("inner_opens", inner)

    by_user = Window.partitionBy("user").orderBy("chunk")
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    seam_prev = F.col("seam_prev")
    seam_opens = (F.col("chunk_no") == 1) | _too_far(cells, spec, F.col("chunk_first"), seam_prev)
    rounds = F.col("inner") + F.col("seam_opens").cast("bigint")
    seams = (
        local.groupBy("user", "chunk")
        .agg(
            F.min("first_ts").alias("chunk_first"),
            F.max("last_ts").alias("chunk_last"),
            F.sum(F.col("inner_opens").cast("bigint")).alias("inner"),
        )
        .withColumns(
            {
                "seam_prev": F.max("chunk_last").over(earlier),
                "chunk_no": F.row_number().over(by_user),
            }
        )
        .withColumn("seam_opens", seam_opens)
        .withColumn("rounds_before", F.coalesce(F.sum(rounds).over(earlier), F.lit(0)))
        .select("user", "chunk", "seam_prev", "seam_opens", "rounds_before")
    )
    head = F.col("position") == 1
    return (
        local.withColumn("local_rounds", F.sum(F.col("inner_opens").cast("bigint")).over(so_far))
        .join(seams, ["user", "chunk"])
        .select(
            *cells.columns,
            F.when(head, seam_prev).otherwise(F.col("local_prev")).alias("prev_ts"),
            F.when(head, F.col("seam_opens")).otherwise(F.col("inner_opens")).alias("opens"),
            (
                F.col("rounds_before")
                + F.col("seam_opens").cast("bigint")
                + F.col("local_rounds")
            ).alias("round_index"),
        )
    )
