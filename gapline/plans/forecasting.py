"""Batch scoring of every entity's latest round."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.latest import latest_rounds
from gapline.plans.artefacts import read_identity
from gapline.schema import USER, col, numeric_columns

#: Of models that were saved without an identity.
MODEL_ID = "baseline:spark"
# Fixed key of the prediction list. The value is a mean: trees fit squared error.
PREDICTION_KEY = "0.5"


def model_features(model: PipelineModel) -> list[str]:
    first = model.stages[0]
    if not isinstance(first, VectorAssembler):
        raise ValueError("the model does not start with an assembler")
    return first.getInputCols()


def _same_features(of_model: list[str], given: list[str], model_id: str) -> None:
    if list(of_model) != list(given):
        raise ValueError(f"model {model_id} was trained on {list(of_model)}, not on {list(given)}")


def score(features: DataFrame, model: PipelineModel, new_labels: bool = False) -> DataFrame:
    """Add ``prediction``. Nulls count as 0.

    A feature the model needs and the table lacks is an error, unless
    ``new_labels`` says that event types may be absent from this period: it is
    then 0.
    """
    needed = model_features(model)
    missing = [c for c in needed if c not in features.columns]
    if missing and not new_labels:
        raise ValueError(f"the feature table lacks {missing}, which the model needs")
    if missing:
        features = features.withColumns({c: F.lit(0.0) for c in missing})
    odd = [c for c in needed if c not in numeric_columns(features)]
    if odd:
        raise ValueError(f"features {odd} are not numeric")
    return model.transform(features.na.fill(0, subset=needed)).drop("features")


def forecast(
    features: DataFrame,
    model: PipelineModel | str,
    horizon: int = 1,
    user_col: str = USER,
    new_labels: bool = False,
    trained_on: list[str] | None = None,
) -> DataFrame:
    """One forecast per entity, from its latest round.

    Columns ``entity_id, horizon, predictions, metadata``; ``horizon`` is only
    echoed, and ``metadata`` names the ``model_id`` if the model is given by its path. Its saved
    feature list must be the model's, and ``trained_on``, if given, as well. Trees are shipped to the executors with the tasks, so the model's
    size, not the data's, is what is broadcast.
    """
    model_id = MODEL_ID
    if isinstance(model, str):
        identity = read_identity(features.sparkSession, model)
        model = PipelineModel.load(model)
        if identity:
            model_id = identity["model_id"]
            _same_features(identity["features"], model_features(model), model_id)
    if trained_on is not None:
        _same_features(model_features(model), trained_on, model_id)
    scored = score(latest_rounds(features, user_col), model, new_labels)
    return scored.select(
        col(user_col).cast("string").alias("entity_id"),
        F.lit(horizon).alias("horizon"),
        F.create_map(F.lit(PREDICTION_KEY), F.array("prediction")).alias("predictions"),
        F.create_map(F.lit("model_id"), F.lit(model_id)).alias("metadata"),
    )
