import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

import gapline as gl
from gapline.plans import training
from gapline.plans.artefacts import first_trees, read_identity
from gapline.plans.forecasting import model_features, score
from gapline.sources.scratch import scratch_dir

FAST = {"max_iter": 4, "max_depth": 3, "parallelism": 3}


@pytest.fixture(scope="module")
def features(events):
    table = gl.round_features(events, ts_col="ts", gap_minutes=240)
    return gl.add_target(table).cache()


@pytest.fixture(scope="module")
def trained(features, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "model")
    return path, gl.train_baseline(features, "target", path, **FAST)


# --- rank and folds ---


def test_rank_equals_row_number(features):
    ranked, total = gl.with_global_rank(features.select("round_start", "round_id"), ["round_start", "round_id"])
    assert total == 6940
    plain = Window.orderBy("round_start", "round_id")
    wrong = ranked.withColumn("want", F.row_number().over(plain) - 1).where("rn <> want")
    assert ranked.count() == total and wrong.isEmpty()


def test_rank_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (1,), (None,)], "x int").repartition(4)
    ranked, total = gl.with_global_rank(df, ["x"])
    assert total == 5
    assert [r.x for r in ranked.orderBy("rn").collect()] == [1, 1, 3, None, None]
    assert [r.rn for r in ranked.orderBy("rn").collect()] == [0, 1, 2, 3, 4]


def test_rank_of_nothing(spark):
    ranked, total = gl.with_global_rank(spark.createDataFrame([], "x int"), ["x"])
    assert (total, ranked.count()) == (0, 0)


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_fold_bounds():
    folds = gl.fold_bounds(17, 5)
    assert [(f.test_from, f.test_to) for f in folds] == [(7, 9), (9, 11), (11, 13), (13, 15), (15, 17)]
    assert gl.fold_bounds(6)[0] == (0, 1, 2)
    with pytest.raises(ValueError, match="too few"):
        gl.fold_bounds(5)
    with pytest.raises(ValueError):
        gl.fold_bounds(10, 1)


def test_fold_table(spark):
    df = spark.range(13).select(F.col("id").alias("x"))
    got = gl.time_series_folds(df, ["x"], 3).groupBy("fold").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "train", F.col("x")))).alias("train"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "test", F.col("x")))).alias("test"),
    )
    assert [(r.train, r.test) for r in got.orderBy("fold").collect()] == [
        (list(range(4)), [4, 5, 6]),
        (list(range(7)), [7, 8, 9]),
        (list(range(10)), [10, 11, 12]),
    ]


# --- training ---


def test_feature_columns(features):
    cols = gl.feature_columns(features, "target")
    assert cols == [
        "event_count", "duration_seconds", "click", "error", "purchase", "signup", "view",
        "gap_since_prev_seconds",
    ]
    device = features.withColumnRenamed("user_id", "device")
    assert gl.feature_columns(device, "target", "device") == cols
    assert gl.feature_columns(features, "target", exclude=["user_id", "click"]) == [
        c for c in cols if c != "click"
    ]


def test_feature_matrix_fills_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, 2.0, 3)], "a int, b double, y int")
    got = gl.feature_matrix(df, ["a", "b"], "y").select(vector_to_array("features"), "label")
    assert sorted(tuple(r) for r in got.collect()) == [([0.0, 2.0], 3.0), ([1.0, 0.0], 0.0)]


@pytest.mark.parametrize(
    "errors, patience, want",
    [
        ([5.0], 50, (1, False)),
        ([5, 4, 3, 2], 2, (4, False)),
        ([5, 4, 4, 4], 2, (2, True)),
        ([5, 4, 4, 4, 1], 2, (2, True)),
        ([5, 4, 6, 3, 6], 2, (4, False)),
        ([1, 2, 3], 50, (1, False)),
    ],
)
def test_patience(errors, patience, want):
    assert gl.best_iteration(errors, patience) == want


def test_patience_against_plain_scan():
    draw = random.Random(3)
    for _ in range(300):
        errors = [draw.randint(0, 9) for _ in range(draw.randint(1, 30))]
        patience = draw.randint(1, 8)
        best, since = 0, 0
        for i in range(1, len(errors)):
            best, since = (i, 0) if errors[i] < errors[best] else (best, since + 1)
            if since == patience:
                break
        assert gl.best_iteration(errors, patience) == (best + 1, since == patience)


def test_training_scores_and_saves(features, trained):
    path, scores = trained
    assert len(scores["cv_maes"]) == len(scores["best_iterations"]) == 5
    assert scores["cv_mae_mean"] == pytest.approx(sum(scores["cv_maes"]) / 5)
    assert scores["cv_mae_mean"] < 0.02  # the target is a tenth of a feature
    model = PipelineModel.load(path)
    assert model_features(model) == gl.feature_columns(features, "target")
    assert model.stages[1].getNumTrees == scores["best_iterations"][-1]
    # The saved model is the last fold's: its error there is the score.
    ranked, rows = gl.with_global_rank(features, ["round_start", "round_id"])
    last = ranked.where(gl.fold_bounds(rows)[-1].test(F.col("rn")))
    mae = score(last, model).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    assert mae == pytest.approx(scores["cv_maes"][-1])


def test_training_repeats(features, trained, tmp_path):
    again = gl.train_baseline(features, "target", str(tmp_path / "m"), **FAST)
    assert again["cv_maes"] == pytest.approx(trained[1]["cv_maes"])


def test_early_stop_cuts_the_model(spark, tmp_path):
    draw = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(f"u_{i}", start + timedelta(hours=i), draw.random(), draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "round_id string, round_start timestamp, x double, y double")
    scores = gl.train_baseline(
        df, "y", str(tmp_path / "m"), n_splits=2, max_iter=12, patience=2, max_depth=2, min_rows=5
    )
    model = PipelineModel.load(str(tmp_path / "m")).stages[1]
    assert model.getNumTrees == scores["best_iterations"][-1] < 12


@pytest.fixture(scope="module")
def noisy(spark):
    draw = random.Random(2)
    rows = [(f"u_{i}", datetime(2024, 1, 1) + timedelta(hours=i), x := draw.random(), x * x + 0.3 * draw.random()) for i in range(400)]
    return spark.createDataFrame(rows, "round_id string, round_start timestamp, x double, y double")


def test_first_trees_equal_a_fit_of_so_many(spark, noisy):
    table = gl.feature_matrix(noisy, ["x"], "y").select("features", "label").cache()
    settings = dict(seed=3, max_depth=3, min_rows=5)
    whole = training._learner(8, **settings).fit(table)
    for count in (1, 5):
        cut, fitted = first_trees(whole, count), training._learner(count, **settings).fit(table)
        assert cut.getNumTrees == count and cut.treeWeights == fitted.treeWeights and cut.getMaxIter() == count
        assert cut.toDebugString.split("\n")[1:] == fitted.toDebugString.split("\n")[1:]
        assert [r.prediction for r in cut.transform(table).collect()] == [r.prediction for r in fitted.transform(table).collect()]
        assert cut.evaluateEachIteration(table, "absolute") == whole.evaluateEachIteration(table, "absolute")[:count]
    assert first_trees(whole, 8) is whole
    with pytest.raises(ValueError, match="8 trees"):
        first_trees(whole, 9)


def test_one_fit_per_fold(spark, noisy, tmp_path, monkeypatch):
    fits, learner = [], training._learner
    monkeypatch.setattr(training, "_learner", lambda trees, **settings: fits.append(trees) or learner(trees, **settings))
    args = dict(n_splits=2, max_iter=12, patience=2, max_depth=3, min_rows=5, first_stage=12)
    scores = gl.train_baseline(noisy, "y", str(tmp_path / "m"), **args)
    assert fits == [12, 12]
    model = PipelineModel.load(str(tmp_path / "m")).stages[1]
    assert model.getNumTrees == scores["best_iterations"][-1]


def test_models_have_identities(spark, noisy, tmp_path):
    args = dict(n_splits=2, max_iter=3, max_depth=2, min_rows=5)
    def train(name, table, **more):
        return gl.train_baseline(table, "y", str(tmp_path / name), **args | more)["model_id"]
    first = train("a", noisy)
    assert first == train("b", noisy.repartition(7)) != train("c", noisy, seed=8, max_depth=1)
    moved = noisy.withColumn("y", F.when(F.col("round_id") == "u_3", -1.0).otherwise(F.col("y")))
    wider = noisy.withColumn("z", F.lit(1.0))
    ids = {first, train("d", moved), train("e", wider)}
    assert len(ids) == 3
    identity = read_identity(spark, str(tmp_path / "a"))
    assert identity["features"] == ["x"] and identity["target"] == "y" and identity["rows"].startswith("267/")
    users = noisy.withColumn("user_id", F.lit("u"))
    assert gl.forecast(users, str(tmp_path / "a"), trained_on=["x"]).first().metadata["model_id"] == first
    with pytest.raises(ValueError, match=f"{first} was trained on \\['x'\\], not on \\['x', 'z'\\]"):
        gl.forecast(users, str(tmp_path / "a"), trained_on=["x", "z"])
    assert read_identity(spark, str(tmp_path / "none")) is None


def test_training_needs_rows_and_features(spark, features, tmp_path):
    few = features.limit(4)
    with pytest.raises(ValueError, match="too few"):
        gl.train_baseline(few, "target", str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no numeric"):
        gl.train_baseline(few.select("round_id", "round_start", "target"), "target", str(tmp_path / "m"))


# --- forecasts ---


def test_forecast(features, trained):
    out = gl.forecast(features, trained[0], horizon=3)
    assert out.dtypes == [
        ("entity_id", "string"), ("horizon", "int"),
        ("predictions", "map<string,array<double>>"), ("metadata", "map<string,string>"),
    ]
    rows = out.collect()
    assert len(rows) == len({r.entity_id for r in rows}) == 150
    assert {r.horizon for r in rows} == {3}
    assert all(list(r.predictions) == ["0.5"] and len(r.predictions["0.5"]) == 1 for r in rows)
    assert {r.metadata["model_id"] for r in rows} == {trained[1]["model_id"]}
    loaded = gl.forecast(features, PipelineModel.load(trained[0])).first()
    assert loaded.metadata == {"model_id": "baseline:spark"}  # no path, no identity


def test_forecast_of_other_columns(features, trained):
    with pytest.raises(ValueError, match="lacks \\['click'\\]"):
        gl.forecast(features.drop("click"), trained[0])
    without = gl.forecast(features.drop("click").withColumn("new", F.lit(1)), trained[0], new_labels=True)
    assert without.count() == 150
    with pytest.raises(ValueError, match="not numeric"):
        gl.forecast(features.withColumn("click", F.lit("a")), trained[0])


def test_nulls_count_as_zero(features, trained):
    empty = features.withColumn("click", F.lit(None).cast("bigint"))
    zero = features.withColumn("click", F.lit(0).cast("bigint"))
    assert gl.forecast(empty, trained[0]).collect() == gl.forecast(zero, trained[0]).collect()


def test_demo(spark, tmp_path):
    scores, forecasts = gl.run_demo(
        spark, "/root/testdata/sf0.001/events.parquet", str(tmp_path),
        etl={"ts_col": "ts", "gap_minutes": 240, "fmt": "parquet"}, training=FAST,
    )
    assert len(scores["cv_maes"]) == 5
    assert forecasts.count() == 15
    assert gl.add_target(forecasts.withColumn("target", F.lit(1))).columns[-1] == "target"
