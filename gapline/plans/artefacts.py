"""What is saved of a model: the first trees of an ensemble, and its identity.

A saved ensemble is a table of tree nodes, a table with a row per tree, and a line of metadata.
Both things here work on these, so they need no training data.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.sources.scratch import exists, temporary_path

IDENTITY = "identity"


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The ensemble of the model's first ``count`` trees: what a fit of so many would have given.

    A tree does not depend on those that follow it, so nothing is fitted again.
    """
    if not 0 < count <= model.getNumTrees:
        raise ValueError(f"the model has {model.getNumTrees} trees, not {count}")
    if count == model.getNumTrees:
        return model
    spark = SparkSession.active()
    whole, cut = temporary_path(spark, "trees"), temporary_path(spark, "first-trees")
    model.write().save(whole)
    # The columns' names and order are the format's own.
    for table, tree in (("data", "treeID"), ("treesMetadata", "_1")):
        spark.read.parquet(f"{whole}/{table}").where(F.col(tree) < count).write.parquet(f"{cut}/{table}")
    about = json.loads(spark.read.text(f"{whole}/metadata").first()[0])
    about["numTrees"] = count
    about["paramMap"]["maxIter"] = count
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{cut}/metadata")
    return GBTRegressionModel.load(cut)


def _digest(rows: DataFrame) -> str:
    """An exact digest of rows in any order: their number and sums of two 64-bit hashes."""
    names = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")

    # The JSON of a row tells nested and missing values apart.
    line = F.to_json(F.struct(*names))
    n, a, b = rows.select(line.alias("line")).agg(F.count("*"), total(F.xxhash64("line")), total(F.xxhash64(F.reverse("line")))).first()
    return f"{n}/{a}/{b}"


def model_identity(model: PipelineModel, features: list[str], training: DataFrame, target_col: str, order_col: str) -> dict:
    """What tells this model from others: features, target, window and digest of its training rows, its trees.

    The ``model_id`` is a hash of all of it: equal for equal rows, features and trees, whatever the files
    and the order of rows; another one if any of them differs.
    """
    spark = training.sparkSession
    window = training.agg(F.min(order_col).cast("string"), F.max(order_col).cast("string")).first()
    path = temporary_path(spark, "identity")
    trees = model.stages[-1]
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData")
    about = {
        "features": list(features), "target": target_col, "first": window[0], "last": window[1],
        "rows": _digest(training.select(*[F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys([*features, target_col])])),
        "trees": _digest(nodes), "weights": list(trees.treeWeights),
    }
    whole = spark.range(1).select(F.sha2(F.lit(json.dumps(about, sort_keys=True)).cast("binary"), 256)).first()[0]
    return {"model_id": whole[:16]} | about


def save_identity(spark: SparkSession, identity: dict, model_path: str) -> None:
    spark.createDataFrame([(json.dumps(identity),)], "value string").coalesce(1).write.mode("overwrite").text(f"{model_path}/{IDENTITY}")


def read_identity(spark: SparkSession, model_path: str) -> dict | None:
    """The identity saved beside a model; None if there is none."""
    if not exists(spark, f"{model_path}/{IDENTITY}"):
        return None
    return json.loads(spark.read.text(f"{model_path}/{IDENTITY}").first()[0])
