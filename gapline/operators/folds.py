"""Time-ordered cross-validation folds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.operators.rank import with_global_rank

DEFAULT_SPLITS = 5


class Fold(NamedTuple):
    """Fold ``fold`` trains on ranks below ``test_from`` and tests ``[test_from, test_to)``."""

    fold: int
    test_from: int
    test_to: int

    def train(self, rank: Column) -> Column:
        return rank < self.test_from

    def test(self, rank: Column) -> Column:
        return (rank >= self.test_from) & (rank < self.test_to)


def fold_bounds(rows: int, n_splits: int = DEFAULT_SPLITS) -> list[Fold]:
    """Expanding training windows, each followed by a test window of equal size.

    With ``t = rows // (n_splits + 1)`` the test windows are the last
    ``n_splits`` runs of ``t`` rows.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    size = rows // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{rows} rows are too few for {n_splits} splits")
    starts = [rows - (n_splits - k) * size for k in range(n_splits)]
    return [Fold(k, start, start + size) for k, start in enumerate(starts)]


def time_series_folds(
    df: DataFrame, order_cols: list[str], n_splits: int = DEFAULT_SPLITS
) -> DataFrame:
    """Rows of every fold with ``rn``, ``fold`` and ``role`` (``train`` or ``test``).

    A row appears once per fold it has a role in. Training reads the folds as
    filters on the rank instead and never builds this table.
    """
    ranked, rows = with_global_rank(df, order_cols)
    rank = F.col("rn")
    roles = [
        F.when(f.train(rank), F.struct(F.lit(f.fold).alias("fold"), F.lit("train").alias("role")))
        .when(f.test(rank), F.struct(F.lit(f.fold).alias("fold"), F.lit("test").alias("role")))
        for f in fold_bounds(rows, n_splits)
    ]
    return ranked.select("*", F.inline(F.array_compact(F.array(*roles))))
