"""Exact global row numbers without a single-task sort."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.schema import col, reject_names, require_columns
from gapline.sources.scratch import written

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits
_OFFSETS = T.StructType(
    [T.StructField("rank_part", T.LongType()), T.StructField("rank_offset", T.LongType())]
)


class RankParts(NamedTuple):
    """First rank of every part of a ranked table, in order, and the number of rows."""

    parts: list[tuple[int, int]]
    rows: int

    def holding(self, low: int, high: int) -> Column:
        """Whether ``rank_part`` can hold ranks of ``[low, high)``: a range that scans can skip files by."""
        ends = [first for _, first in self.parts[1:]] + [self.rows]
        held = [part for (part, first), end in zip(self.parts, ends) if first < high and end > low]
        if not held:
            return F.lit(False)
        return F.col("rank_part").between(min(held), max(held))


def with_global_rank(
    df: DataFrame, order_by: list[str | Column], rank_col: str = "rn"
) -> tuple[DataFrame, int]:
    """Add the 0-based position of every row in the order ``order_by``.

    Returns the ranked table and its number of rows. Ascending, nulls last; give
    columns that together are unique, or ties are broken arbitrarily (but once:
    the result is a written table and does not change when read again).

    Rows are range-partitioned on the order columns and sorted within their
    partition, so equal leading values spread over partitions as long as the
    later order columns differ. One run writes the rows with their partition and
    position; the row counts per partition (one small row each) then give the
    offset of each partition.
    """
    ranked, parts = with_rank_parts(df, order_by, rank_col)
    return ranked.drop("rank_part"), parts.rows


def with_rank_parts(
    df: DataFrame, order_by: list[str | Column], rank_col: str = "rn"
) -> tuple[DataFrame, RankParts]:
    """As :func:`with_global_rank`, with the column ``rank_part`` kept and its ranges given."""
    reject_names([rank_col, "rank_part", "rank_pos", "rank_offset"], df.columns, "columns")
    require_columns(df, *[c for c in order_by if isinstance(c, str)])
    keys = [(col(c) if isinstance(c, str) else c) for c in order_by]
    order = [k.asc_nulls_last() for k in keys]
    row_id = F.monotonically_increasing_id()
    placed = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("rank_id", row_id)
        .withColumn("rank_part", F.shiftright("rank_id", _LOCAL_BITS))
        .withColumn("rank_pos", F.col("rank_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("rank_id"),
        "rank",
    )
    # As many rows as there were shuffle partitions, whatever the data size.
    counts = sorted(placed.groupBy("rank_part").count().collect())
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    offset_table = df.sparkSession.createDataFrame(offsets, _OFFSETS)
    ranked = (
        placed.join(F.broadcast(offset_table), "rank_part")
        .withColumn(rank_col, F.col("rank_pos") + F.col("rank_offset"))
        .select(*df.columns, "rank_part", rank_col)
    )
    return ranked, RankParts(offsets, total)
