"""Recordings to forecasts in one application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.plans.etl import run_etl
from gapline.plans.forecasting import forecast
from gapline.plans.training import train_baseline


def add_target(features: DataFrame, target_col: str = "target", value: Column | None = None) -> DataFrame:
    """Add a target unless the table has one. The default, a tenth of
    ``event_count``, leaks a feature and is only good for trying things out."""
    if target_col in features.columns:
        return features
    return features.withColumn(target_col, F.col("event_count") * 0.1 if value is None else value)


def run_demo(
    spark: SparkSession,
    source: str,
    work_dir: str,
    horizon: int = 1,
    etl: dict | None = None,
    training: dict | None = None,
) -> tuple[dict, DataFrame]:
    """ETL, target, training, forecast; returns scores and forecasts.

    An existing feature table in ``work_dir`` is used as it is.
    """
    etl = {"mode": "ignore"} | (etl or {})
    features = run_etl(spark, source, f"{work_dir}/round_features", **etl)
    table = add_target(features)
    user = {"user_col": etl["user_col"]} if "user_col" in etl else {}
    scores = train_baseline(table, "target", f"{work_dir}/model", **user, **(training or {}))
    return scores, forecast(table, f"{work_dir}/model", horizon, **user)
