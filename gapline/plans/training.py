"""Boosted-tree training with time-ordered cross-validation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.plans.artefacts import first_trees, model_identity, save_identity
from gapline.operators.folds import DEFAULT_SPLITS, Fold, fold_bounds
from gapline.operators.rank import with_rank_parts
from gapline.schema import USER, col, numeric_columns, require_columns
from gapline.sources.scratch import cleared, scratch_dir

MAX_ITER = 1000
PATIENCE = 50
STEP_SIZE = 0.05
ORDER = ["round_start", "round_id"]


def feature_columns(
    df: DataFrame, target_col: str, user_col: str = USER, exclude: list[str] | None = None
) -> list[str]:
    """Numeric columns that are neither key nor target, in table order.

    ``exclude`` replaces the default list of left-out columns. Columns that are
    not numeric can never be features.
    """
    if exclude is None:
        exclude = ["round_id", user_col, "round_start", "round_end"]
    left_out = {*exclude, target_col}
    return [c for c in numeric_columns(df) if c not in left_out]


def assembler(features: list[str]) -> VectorAssembler:
    """The model's first stage; its input columns are the model's feature list."""
    return VectorAssembler(inputCols=features, outputCol="features")


def feature_matrix(df: DataFrame, features: list[str], target_col: str) -> DataFrame:
    """``features`` vector and ``label``, nulls as 0; other columns are kept."""
    filled = df.na.fill(0, subset=features).withColumn(
        "label", F.coalesce(col(target_col).cast("double"), F.lit(0.0))
    )
    return assembler(features).transform(filled)


def best_iteration(errors: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Number of trees to keep, and whether patience ran out.

    The first strict minimum counts; the scan stops when ``patience`` iterations
    bring no strict improvement.
    """
    if not errors:
        raise ValueError("no iterations to choose from")
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _learner(trees: int, seed: int, max_depth: int, min_rows: int) -> GBTRegressor:
    # Depth 5 is 32 leaves; checkpoints keep the lineage of long runs short.
    return GBTRegressor(
        featuresCol="features",
        labelCol="label",
        lossType="squared",
        maxIter=trees,
        stepSize=STEP_SIZE,
        maxDepth=max_depth,
        minInstancesPerNode=min_rows,
        maxBins=255,
        seed=seed,
        checkpointInterval=10,
    )


def _fit_with_patience(
    train: DataFrame, test: DataFrame, max_iter: int, patience: int, first_stage: int | None = None, **settings
) -> tuple[GBTRegressionModel, int, float]:
    """Fit until patience runs out; returns the model, its best size and error.

    A model's first trees are the model of so many trees, so one pass over the test rows gives the
    errors of all sizes, and the model is cut to the best one without another fit. Where patience
    runs out within the first stage there is one fit. Otherwise the stage is doubled: MLlib cannot go on
    with an ensemble, so its trees are grown again, in all up to twice the last stage's.
    """
    stage = min(max_iter, max(first_stage or 0, 2 * patience))
    while True:
        model = _learner(stage, **settings).fit(train)
        errors = model.evaluateEachIteration(test, "absolute")
        size, stopped = best_iteration(errors, patience)
        if stopped or stage == max_iter:
            return model, size, errors[size - 1]
        stage = min(max_iter, 2 * stage)


def train_baseline(
    features: DataFrame,
    target_col: str,
    model_out: str,
    features_exclude: list[str] | None = None,
    user_col: str = USER,
    n_splits: int = DEFAULT_SPLITS,
    max_iter: int = MAX_ITER,
    patience: int = PATIENCE,
    seed: int = 42,
    max_depth: int = 5,
    min_rows: int = 20,
    parallelism: int = 1,
    first_stage: int | None = None,
) -> dict:
    """Cross-validate, save the last fold's model and return its scores.

    Returns ``cv_maes`` per fold, their mean ``cv_mae_mean``, ``best_iterations``, and the ``model_id``.
    The model directory holds a ``PipelineModel`` of assembler and trees, and its identity
    (see :func:`gapline.plans.artefacts.model_identity`). ``first_stage`` trees are grown before
    patience is looked at (at least twice ``patience``): ``max_iter`` makes one fit per fold. Rows are ordered by ``round_start``, ties by
    ``round_id``. ``parallelism`` folds are fitted at the same time, each with
    its training rows cached by the learner: raise it where the jobs of one fold
    leave cores idle. The table of ranked rows is deleted once the model is saved.
    """
    require_columns(features, target_col, *ORDER)
    cols = feature_columns(features, target_col, user_col, features_exclude)
    if not cols:
        raise ValueError("no numeric feature columns are left")
    scratch_dir(features.sparkSession)  # makes sure the learner can checkpoint
    keep = list(dict.fromkeys([*ORDER, *cols, target_col]))
    settings = dict(seed=seed, max_depth=max_depth, min_rows=min_rows)
    rank = F.col("rn")
    with cleared(features.sparkSession):
        ranked, parts = with_rank_parts(features.select(*[col(c) for c in keep]), ORDER)
        folds = fold_bounds(parts.rows, n_splits)
        table = feature_matrix(ranked, cols, target_col).select("rank_part", "rn", "features", "label")

        def train(fold: Fold) -> DataFrame:
            return table.where(parts.holding(0, fold.test_from) & fold.train(rank))

        def fit(fold: Fold) -> tuple[GBTRegressionModel, int, float]:
            test = table.where(parts.holding(fold.test_from, fold.test_to) & fold.test(rank))
            return _fit_with_patience(train(fold), test, max_iter, patience, first_stage, **settings)

        with ThreadPool(min(parallelism, len(folds))) as pool:
            fitted = pool.map(inheritable_thread_target(features.sparkSession)(fit), folds, chunksize=1)
        model, size, _ = fitted[-1]
        maes = [mae for _, _, mae in fitted]
        # Only the last fold's model is kept, so only it is cut back to its best size.
        model = PipelineModel(stages=[assembler(cols), first_trees(model, size)])
        model.write().overwrite().save(model_out)
        rows = ranked.where(parts.holding(0, folds[-1].test_from) & folds[-1].train(rank))
        identity = model_identity(model, cols, rows, target_col, ORDER[0])
        save_identity(features.sparkSession, identity, model_out)
    return {
        "cv_mae_mean": sum(maes) / len(maes),
        "cv_maes": maes,
        "best_iterations": [size for _, size, _ in fitted],
        "model_id": identity["model_id"],
    }
