"""Drift, degradation and the decision to retrain.

The formulas are this package's own choice; they are stated with each function.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.schema import col, require_columns

DRIFT_THRESHOLD = 0.2
ERROR_THRESHOLD = 1.2
# A bin that one period lacks counts as this share, so that total drift is large, not endless.
LEAST_SHARE = 1e-4


def feature_drift(
    features: DataFrame,
    split_at: datetime | str,
    edges: dict[str, list[float]],
    time_col: str = "round_start",
) -> DataFrame:
    """Compare rounds from ``split_at`` on (current) with those before (base).

    Per feature in ``edges``: mean and population standard deviation of both
    periods; ``mean_shift = (current_mean - base_mean) / base_stddev``, null if
    that deviation is 0; and ``stability_index``, the sum over bins of
    ``(c - b) * ln(c / b)`` with ``b`` and ``c`` the bin's share of each period, at least
    ``LEAST_SHARE``, over bins that occur in either. It is null if a period is empty. ``edges`` are ascending inner bin limits; a
    value equal to a limit falls above it. Null values are left out.

    One scan: rows turn into (feature, bin) partial sums on the mapper, and only
    those are shuffled.
    """
    if not edges:
        raise ValueError("edges must name at least one feature")
    require_columns(features, time_col, *edges)
    when = col(time_col)
    border = F.lit(split_at).cast(features.schema[time_col].dataType)

    def entry(name: str, limits: list[float]) -> Column:
        value = col(name).cast("double")
        bin_no = F.lit(0)
        for limit in limits:
            bin_no = bin_no + (value >= F.lit(float(limit))).cast("int")
        return F.struct(F.lit(name).alias("feature"), value.alias("value"), bin_no.alias("bin"))

    entries = features.where(when.isNotNull()).select(
        (when >= border).alias("current"),
        F.inline(F.array(*[entry(n, limits) for n, limits in edges.items()])),
    )
    base = F.when(~F.col("current"), F.col("value"))
    current = F.when(F.col("current"), F.col("value"))
    sums = (
        entries.where(F.col("value").isNotNull())
        .groupingSets([["feature", "bin"], ["feature"]], "feature", "bin")
        .agg(
            F.grouping("bin").alias("whole"),
            F.count(base).alias("base_rows"),
            F.count(current).alias("current_rows"),
            F.avg(base).alias("base_mean"),
            F.avg(current).alias("current_mean"),
            F.stddev_pop(base).alias("base_stddev"),
            F.stddev_pop(current).alias("current_stddev"),
        )
    )
    # From here on there is one row per feature and bin.
    whole = F.col("whole") == 1
    of_feature = Window.partitionBy("feature")

    def share(rows: str) -> Column:
        total = F.max(F.when(whole, F.col(rows))).over(of_feature)
        return F.try_divide(F.col(rows), total)  # a period may be empty

    # Null if the period is empty: greatest() would skip that.
    b, c = (F.when(F.col(x) < LEAST_SHARE, LEAST_SHARE).otherwise(F.col(x)) for x in ("base_share", "current_share"))
    kept = [
        "base_rows", "current_rows", "base_mean", "current_mean", "base_stddev", "current_stddev",
    ]
    return (
        sums.withColumn("base_share", share("base_rows"))
        .withColumn("current_share", share("current_rows"))
        .groupBy("feature")
        .agg(
            *[F.max(F.when(whole, F.col(k))).alias(k) for k in kept],
            F.sum(F.when(~whole & b.isNotNull() & c.isNotNull(), (c - b) * F.ln(c / b))).alias("stability_index"),
        )
        .withColumn(
            "mean_shift",
            F.when(
                F.col("base_stddev") != 0,
                (F.col("current_mean") - F.col("base_mean")) / F.col("base_stddev"),
            ),
        )
        .select("feature", *kept, "mean_shift", "stability_index")
    )


def model_degradation(
    scored: DataFrame,
    baseline_mae: float,
    unit: str = "DAY",
    label_col: str = "label",
    prediction_col: str = "prediction",
    time_col: str = "round_start",
) -> DataFrame:
    """Mean absolute error per ``unit`` of time, and its ratio to ``baseline_mae``.

    Columns ``period, rows, mae, mae_ratio``. Rows without a label, prediction
    or time are left out.
    """
    if baseline_mae <= 0:
        raise ValueError("baseline_mae must be positive")
    require_columns(scored, label_col, prediction_col, time_col)
    dtype = scored.schema[time_col].dataType
    error = F.abs(col(label_col) - col(prediction_col))
    period = F.date_trunc(unit, col(time_col)).cast(dtype)
    return (
        scored.select(period.alias("period"), error.alias("error"))
        .where("period is not null and error is not null")
        .groupBy("period")
        .agg(F.count("*").alias("rows"), F.avg("error").alias("mae"))
        .withColumn("mae_ratio", F.col("mae") / F.lit(float(baseline_mae)))
    )


def retrain_decision(
    drift: DataFrame,
    degradation: DataFrame,
    drift_threshold: float = DRIFT_THRESHOLD,
    error_threshold: float = ERROR_THRESHOLD,
) -> DataFrame:
    """One row: ``should_retrain`` and the sorted ``reasons``.

    A reason is a feature whose stability index is above ``drift_threshold``
    (``drift: <feature>``) or null, as one period has no value (``no data: <feature>``), or an error ratio of the latest period above
    ``error_threshold`` (``error``). It decides only; it starts nothing.
    """
    index = F.col("stability_index")
    drifted = drift.where(index.isNull() | (index > drift_threshold)).select(
        F.concat(F.when(index.isNull(), F.lit("no data: ")).otherwise(F.lit("drift: ")), F.col("feature")).alias("reason")
    )
    worse = (
        degradation.agg(F.max_by("mae_ratio", "period").alias("ratio"))
        .where(F.col("ratio") > error_threshold)
        .select(F.lit("error").alias("reason"))
    )
    # At most one reason per feature and one more.
    return drifted.union(worse).agg(
        (F.count("*") > 0).alias("should_retrain"),
        F.array_sort(F.collect_list("reason")).alias("reasons"),
    )
