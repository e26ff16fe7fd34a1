"""The latest round of every entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.schema import USER, col, require_columns


def latest_rounds(features: DataFrame, user_col: str = USER) -> DataFrame:
    """One row per user: the round that started last.

    Spark turns the rank filter into a limit per group before the shuffle, so
    every mapper sends at most one row per user.
    """
    require_columns(features, user_col, "round_start", "round_id")
    newest = Window.partitionBy(col(user_col)).orderBy(
        F.col("round_start").desc_nulls_last(), F.col("round_id").desc()
    )
    return (
        features.withColumn("_newest", F.row_number().over(newest))
        .where(F.col("_newest") == 1)
        .drop("_newest")
    )
