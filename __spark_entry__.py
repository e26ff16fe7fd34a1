"""

Every query reads whole tables. Gaps are in minutes; ``events`` has its rounds
cut at 240 minutes unless the name says otherwise.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml import PipelineModel  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import gapline as gl  # noqa: E402
from gapline.plans.forecasting import score  # noqa: E402
from gapline.sources.scratch import scratch_path, written  # noqa: E402

# The operators of training-data pipelines may be left out; if they are there, they must import.
LLM = importlib.util.find_spec("gapline.llm") and importlib.util.find_spec("gapline.llm.queries")
if LLM:
    from gapline.llm import queries as llm_queries  # noqa: E402
    import corpus_pipeline  # noqa: E402

GAP = 240
USER, TIME = "user_id", "ts"
LABELS = ["click", "error", "purchase", "signup", "view"]
SPLIT_AT = "2024-01-16 00:00:00"
EDGES = {
    "duration_seconds": [1, 3600, 7200, 14400],
    "event_count": [2, 3, 5, 8],
    "gap_since_prev_seconds": [0, 18000, 43200, 86400],
}
BASELINE_MAE = 0.3
LEVELS = [f"p{k}" for k in range(20)]
FEATURES = ["event_count", "duration_seconds", *LABELS, "gap_since_prev_seconds"]
# Few and shallow trees: the queries show the whole path, not the best model.
TRAINING = {"max_iter": 4, "max_depth": 3, "n_splits": 5, "parallelism": 5}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _features(spark: SparkSession, sf_dir: str, gap: float = GAP) -> DataFrame:
    return gl.round_features(_table(spark, sf_dir, "events"), USER, TIME, gap, labels=LABELS)


def _sessionized(spark: SparkSession, sf_dir: str, gap: float = GAP) -> DataFrame:
    return gl.sessionize(_table(spark, sf_dir, "events"), USER, TIME, gap)


# --- rounds ---------------------------------------------------------------


def sessionize_events(spark, sf_dir):
    return _sessionized(spark, sf_dir)


def sessionize_events_default_gap(spark, sf_dir):
    return _sessionized(spark, sf_dir, 30)


def sessionize_events_short_gap(spark, sf_dir):
    """Below a minute users are numbered chunk by chunk."""
    return _sessionized(spark, sf_dir, 0.5)


def sessionize_orders(spark, sf_dir):
    return gl.sessionize(
        _table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 90 * 24 * 60
    )


def sessionize_missing_times(spark, sf_dir):
    """Errors have lost their time."""
    events = _table(spark, sf_dir, "events").select("event_id", USER, TIME, "event_type")
    holed = events.withColumn(TIME, F.when(F.col("event_type") != "error", F.col(TIME)))
    sessionized = gl.sessionize(holed, USER, TIME, GAP)
    # Which of a user's untimed events gets which number is open: leave out their id.
    return sessionized.withColumn("event_id", F.when(F.col(TIME).isNotNull(), F.col("event_id")))


def round_bounds(spark, sf_dir):
    return gl.round_bounds(_sessionized(spark, sf_dir), USER, TIME)


def rounds_by_session_window(spark, sf_dir):
    return gl.session_rounds(_table(spark, sf_dir, "events"), USER, TIME, GAP)


def distinct_rounds(spark, sf_dir):
    return _sessionized(spark, sf_dir).agg(F.countDistinct("round_id").alias("rounds"))


# --- features -------------------------------------------------------------


def round_features(spark, sf_dir):
    return gl.round_features(_table(spark, sf_dir, "events"), USER, TIME, GAP)


def round_features_of_sessionized(spark, sf_dir):
    return gl.compute_round_features(
        _sessionized(spark, sf_dir), USER, ts_col=TIME, gap_minutes=GAP
    )


def round_features_short_gap(spark, sf_dir):
    return _features(spark, sf_dir, 0.5)


def round_features_missing_times(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(USER, TIME, "event_type")
    holed = events.withColumn(TIME, F.when(F.col("event_type") != "error", F.col(TIME)))
    return gl.round_features(holed, USER, TIME, GAP)


def event_type_labels(spark, sf_dir):
    labels = gl.event_type_labels(_table(spark, sf_dir, "events"))
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "position long, label string")


def event_type_crosstab(spark, sf_dir):
    return _features(spark, sf_dir).select("round_id", *LABELS)


def event_type_map(spark, sf_dir):
    """Event types of each round as a map, here written out: no pass to find the types."""
    maps = gl.label_maps(_table(spark, sf_dir, "events"), USER, TIME, GAP)
    entries = F.transform(F.map_entries("label_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("round_id", USER, F.array_join(entries, ",").alias("label_counts"))


def order_price_levels(spark, sf_dir):
    """Rounds of a customer's orders, with a count per price level of 10,000: more columns than are kept apart."""
    orders = _table(spark, sf_dir, "orders")
    level = F.concat(F.lit("p"), F.floor(F.col("o_totalprice") / 10_000).cast("string"))
    events = orders.select("o_custkey", "o_orderdate", level.alias("event_type"))
    return gl.round_features(events, "o_custkey", "o_orderdate", 90 * 24 * 60, labels=LEVELS)


def prev_round_gap(spark, sf_dir):
    return _features(spark, sf_dir).select("round_id", "prev_round_end", "gap_since_prev_seconds")


def target_projection(spark, sf_dir):
    return gl.add_target(_features(spark, sf_dir)).select("round_id", "target")


def feature_matrix(spark, sf_dir):
    table = gl.add_target(_features(spark, sf_dir))
    cols = gl.feature_columns(table, "target", USER)
    values = vector_to_array("features")
    return gl.feature_matrix(table, cols, "target").select(
        "round_id", "label", *[values[i].alias(f"x_{c}") for i, c in enumerate(cols)]
    )


def latest_round(spark, sf_dir):
    return gl.latest_rounds(_features(spark, sf_dir), USER)


def top_rounds(spark, sf_dir):
    longest = _features(spark, sf_dir).orderBy(F.desc("duration_seconds"), "round_id").limit(20)
    return longest.select("round_id", "duration_seconds", "event_count")


# --- sources and sinks ----------------------------------------------------


def csv_etl_roundtrip(spark, sf_dir):
    source, out = scratch_path(spark, "recordings"), scratch_path(spark, "features")
    events = _table(spark, sf_dir, "events").select(
        USER, F.col(TIME).cast("string").alias("recorded_at"), "event_type", "value"
    )
    events.write.option("header", True).csv(source)
    schema = "user_id bigint, recorded_at string, event_type string, value double"
    features = gl.run_etl(spark, source, out, gap_minutes=GAP, schema=schema)
    times = ["round_start", "round_end", "prev_round_end"]
    return features.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _damaged(spark, sf_dir):
    """Errors have lost their user, sign-ups have an unreadable time."""
    kind, time = F.col("event_type"), F.col(TIME).cast("string")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind != "error", F.col(USER)).alias(USER),
        F.when(kind == "signup", F.concat(F.lit("at "), time)).otherwise(time).alias("recorded_at"),
    )


def rejected_events(spark, sf_dir):
    return gl.split_rejects(_damaged(spark, sf_dir))[1]


def rejected_lines(spark, sf_dir):
    """Errors have one field too many, sign-ups a text where the value stands."""
    source, out, rejects = (scratch_path(spark, n) for n in ("damaged", "features", "rejects"))
    kind = F.col("event_type")
    value = F.when(kind == "signup", "oops").otherwise(F.col("event_id").cast("string"))
    fields = [F.col(USER).cast("string"), F.col(TIME).cast("string"), kind, value, F.when(kind == "error", "extra")]
    # Written as one column whose name is the header line.
    line = F.concat_ws(",", *fields).alias("user_id,recorded_at,event_type,value")
    plain = {"header": "true", "sep": "\u0001", "quote": "\u0000"}
    _table(spark, sf_dir, "events").select(line).write.options(**plain).csv(source)
    schema = "user_id bigint, recorded_at string, event_type string, value double"
    gl.run_etl(spark, source, out, gap_minutes=GAP, schema=schema, rejects=rejects)
    written_rejects = spark.read.parquet(rejects)
    return written_rejects.groupBy("reject_reason").agg(F.count("*").alias("lines"), F.count("malformed_line").alias("kept"))


def rounds_without_rejects(spark, sf_dir):
    good, _ = gl.split_rejects(_damaged(spark, sf_dir))
    features = gl.round_features(good, gap_minutes=GAP)
    return features.select("round_id", "event_count", "duration_seconds", "gap_since_prev_seconds")


# --- folds, training, forecasts -------------------------------------------


def _folds(spark, sf_dir):
    table = _features(spark, sf_dir).select("round_start", "round_id", "event_count", "duration_seconds")
    return gl.time_series_folds(table, ["round_start", "round_id"])


def global_rank(spark, sf_dir):
    table = _features(spark, sf_dir).select("round_start", "round_id")
    ranked, _ = gl.with_global_rank(table, ["round_start", "round_id"])
    return ranked.select("round_id", "rn")


def time_series_folds(spark, sf_dir):
    return _folds(spark, sf_dir).select("round_id", "rn", "fold", "role")


def fold_mae_closed_form(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    x, y = F.col("event_count"), F.col("duration_seconds")
    lines = (
        folds.where("role = 'train'")
        .groupBy("fold")
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    )
    # One row per fold: the number of splits bounds it.
    tested = folds.where("role = 'test'").join(F.broadcast(lines), "fold")
    error = F.abs(y - (F.col("slope") * x + F.col("intercept")))
    return tested.groupBy("fold").agg(F.round(F.avg(error), 6).alias("mae"))


def _trained(spark, sf_dir):
    table = written(gl.add_target(_features(spark, sf_dir)), "features")
    model = scratch_path(spark, "model")
    return table, model, gl.train_baseline(table, "target", model, user_col=USER, **TRAINING)


def train_cv(spark, sf_dir):
    _, _, scores = _trained(spark, sf_dir)
    rows = [(k, m, scores["cv_mae_mean"]) for k, m in enumerate(scores["cv_maes"])]
    return spark.createDataFrame(rows, "fold int, mae double, cv_mae_mean double")


def forecast_batch(spark, sf_dir):
    table, model, _ = _trained(spark, sf_dir)
    return gl.forecast(table, model, user_col=USER)


def model_scores(spark, sf_dir):
    """Daily error of the trained model over the whole feature table."""
    table, model, scores = _trained(spark, sf_dir)
    scored = score(table, PipelineModel.load(model))
    return gl.model_degradation(scored, scores["cv_mae_mean"], label_col="target")


def demo_run(spark, sf_dir):
    _, forecasts = gl.run_demo(
        spark,
        f"{sf_dir}/events.parquet",
        scratch_path(spark, "demo"),
        etl={"user_col": USER, "ts_col": TIME, "gap_minutes": GAP, "fmt": "parquet"},
        training=TRAINING,
    )
    return forecasts


# A tree of depth 1 on a feature of 0 and 1 predicts the mean target of its group, which SQL can state.
BOOSTED = 9
STUMP = {"max_iter": 1, "max_depth": 1, "min_rows": 1, "n_splits": 5, "parallelism": 5}


def _stump_table(spark, sf_dir):
    busy = (F.col("event_count") > 1).cast("int").alias("busy")
    return _features(spark, sf_dir).select("*", busy)


def _stump_excludes(table, *kept):
    return [c for c in table.columns if c not in kept]


def _stump(spark, sf_dir):
    table, model = written(_stump_table(spark, sf_dir), "features"), scratch_path(spark, "model")
    excluded = _stump_excludes(table, "busy")
    return table, model, gl.train_baseline(table, "duration_seconds", model, excluded, USER, **STUMP)


def train_cv_stump(spark, sf_dir):
    scores = _stump(spark, sf_dir)[2]
    rows = [(k, round(m, 6), round(scores["cv_mae_mean"], 6)) for k, m in enumerate(scores["cv_maes"])]
    return spark.createDataFrame(rows, "fold int, mae double, cv_mae_mean double")


def _flat(forecasts, model_id):
    """One row per prediction. Whether the id is the trained model's is all SQL can say of it."""
    own = (F.col("metadata")["model_id"] == model_id).alias("own_model")
    return forecasts.select(
        "entity_id", "horizon", F.explode("predictions").alias("key", "values"), own
    ).select("entity_id", "horizon", "key", F.round(F.col("values")[0], 6).alias("prediction"), "own_model")


def forecast_stump(spark, sf_dir):
    table, model, scores = _stump(spark, sf_dir)
    return _flat(gl.forecast(table, model, horizon=3, user_col=USER), scores["model_id"])


def demo_stump(spark, sf_dir):
    """Run twice in one folder: the second run finds the features there and uses them."""
    work = scratch_path(spark, "demo")
    etl = {"user_col": USER, "ts_col": TIME, "gap_minutes": GAP, "fmt": "parquet", "labels": LABELS}
    kept = [c for c in gl.schema.FEATURE_COLUMNS if c != "event_count"] + LABELS + [USER]
    training = STUMP | {"features_exclude": kept, "max_depth": 1}
    for source in (f"{sf_dir}/events.parquet", f"{sf_dir}/no-such-table.parquet"):
        scores, forecasts = gl.run_demo(spark, source, work, etl=etl, training=training)
    return _flat(forecasts, scores["model_id"])


def early_stop_stump(spark, sf_dir):
    """The target is the feature: the first tree is exact, no later one is better, patience runs out."""
    table, model = written(_stump_table(spark, sf_dir), "features"), scratch_path(spark, "model")
    table = table.withColumn("target", F.col("busy").cast("double"))
    training = STUMP | {"max_iter": 12, "patience": 2}
    scores = gl.train_baseline(table, "target", model, _stump_excludes(table, "busy"), USER, **training)
    trees = PipelineModel.load(model).stages[1].getNumTrees
    rows = [(k, round(m, 6), b, trees) for k, (m, b) in enumerate(zip(scores["cv_maes"], scores["best_iterations"]))]
    return spark.createDataFrame(rows, "fold int, mae double, best_iteration int, trees int")


def early_stop_two_features(spark, sf_dir):
    """Stumps on two features of 0 and 1, of which the first tree takes the one that matters most."""
    table, model = written(_two_feature_table(spark, sf_dir), "features"), scratch_path(spark, "model")
    training = STUMP | {"max_iter": BOOSTED, "patience": BOOSTED, "first_stage": BOOSTED}
    scores = gl.train_baseline(table, "target", model, _stump_excludes(table, "busy", "morning"), USER, **training)
    trees = PipelineModel.load(model).stages[1].getNumTrees
    rows = [(k, round(m, 6), b, trees) for k, (m, b) in enumerate(zip(scores["cv_maes"], scores["best_iterations"]))]
    return spark.createDataFrame(rows, "fold int, mae double, best_iteration int, trees int")


def _two_feature_table(spark, sf_dir):
    morning = F.hour("round_start") < 12
    busy = F.col("event_count") > 1
    return _features(spark, sf_dir).select(
        "*", busy.cast("int").alias("busy"), morning.cast("int").alias("morning"),
        (F.when(busy, 10).otherwise(0) + F.when(morning, 1).otherwise(0) + F.pmod("event_count", F.lit(3)) * 0.25).cast("double").alias("target"),
    )


# --- streaming and monitoring ---------------------------------------------


def _streamed(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    out = scratch_path(spark, "closed-rounds")
    query = gl.stream_rounds(
        spark,
        f"{sf_dir}/{{events.parquet}}",  # a glob, for a stream reads folders, and the table may be a file
        events.schema,
        out,
        scratch_path(spark, "stream-state"),
        USER,
        TIME,
        GAP,
        delay_minutes=10,
        labels=LABELS,
    )
    query.awaitTermination()
    rounds = spark.read.parquet(out)
    times = ["round_start", "round_end"]
    return rounds.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def stream_late_events(spark, sf_dir):
    """Two runs over one checkpoint; the second finds views older than the watermark, and drops them."""
    events = _table(spark, sf_dir, "events").select("event_id", USER, TIME, "event_type")
    source, out, state = (scratch_path(spark, n) for n in ("arriving", "closed-rounds", "stream-state"))
    newest = events.agg(F.max(TIME)).first()[0]
    views = F.col("event_type") == "view"
    far = F.lit(newest).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    mark = events.limit(1).select("event_id", F.lit(-1).cast(events.schema[USER].dataType).alias(USER), far.alias(TIME), F.lit("click").alias("event_type"))
    for part in (events.where(~views).union(mark), events.where(views)):
        part.write.mode("append").parquet(source)
        query = gl.stream_rounds(spark, source, events.schema, out, state, USER, TIME, GAP, labels=LABELS)
        query.awaitTermination()
    return spark.read.parquet(out).select(USER, "event_count", *LABELS)


def stream_closed_rounds(spark, sf_dir):
    return _streamed(spark, sf_dir)


def stream_round_features(spark, sf_dir):
    return gl.index_closed_rounds(_streamed(spark, sf_dir), USER, GAP, LABELS)


def _store(spark):
    path = scratch_path(spark, "store")
    return gl.open_store(spark, path, USER, TIME, GAP, LABELS, user_type="bigint")


def _as_ntz(features: DataFrame) -> DataFrame:
    times = ["round_start", "round_end", "prev_round_end"]
    return features.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _in_parts(events: DataFrame, n: int) -> list[DataFrame]:
    """The log in ``n`` spans of equal length."""
    first, last = events.agg(F.min(TIME), F.max(TIME)).first()
    cuts = [F.lit(first + k * (last - first) / n) for k in range(1, n)]
    time = F.col(TIME)
    return [events.where((time >= a if a is not None else F.lit(True)) & (time < b if b is not None else F.lit(True))) for a, b in zip([None, *cuts], [*cuts, None])]


def stream_numbered_rounds(spark, sf_dir):
    """Three runs over one checkpoint; each reads what has arrived and one row per user of what was there."""
    events = _table(spark, sf_dir, "events").select("event_id", USER, TIME, "event_type")
    store, source, state = _store(spark), scratch_path(spark, "arriving"), scratch_path(spark, "stream-state")
    for part in _in_parts(events, 3):
        part.write.mode("append").parquet(source)
        store.stream(source, events.schema, state).awaitTermination()
    last = events.agg(F.max(TIME)).first()[0]
    return _as_ntz(store.rounds(F.lit(last).cast("timestamp") - F.expr("INTERVAL 10 MINUTES")))


def stream_repaired_rounds(spark, sf_dir):
    """Views arrive after everything else. What comes too late is kept, and the repair puts it where it belongs."""
    events = _table(spark, sf_dir, "events").select("event_id", USER, TIME, "event_type")
    store, source, state = _store(spark), scratch_path(spark, "arriving"), scratch_path(spark, "stream-state")
    views = F.col("event_type") == "view"
    for part in (events.where(~views), events.where(views)):
        part.write.mode("append").parquet(source)
        store.stream(source, events.schema, state).awaitTermination()
    store.repair()
    return _as_ntz(store.rounds())


def etl_in_days(spark, sf_dir):
    """The log in spans of a few days, each added to the table the ones before have made."""
    store = _store(spark)
    for number, part in enumerate(_in_parts(_table(spark, sf_dir, "events"), 5)):
        store.add(part, number)
    return _as_ntz(store.rounds())


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _drift(features):
    return gl.feature_drift(features, SPLIT_AT, EDGES)


def _degradation(features):
    guessed = features.withColumn("prediction", 1 + F.col("duration_seconds") / 7200.0)
    return gl.model_degradation(guessed, BASELINE_MAE, label_col="event_count")


def feature_drift(spark, sf_dir):
    values = ["base_mean", "current_mean", "base_stddev", "current_stddev", "mean_shift", "stability_index"]
    return _rounded(_drift(_features(spark, sf_dir)), *values)


def drift_from_sketches(spark, sf_dir):
    """From a table of daily summaries: feature rows are not read again."""
    daily = written(gl.feature_sketches(_features(spark, sf_dir), list(EDGES)), "sketches")
    values = ["base_mean", "current_mean", "base_stddev", "current_stddev", "mean_shift", "stability_index"]
    return _rounded(gl.drift_from_sketches(daily, SPLIT_AT), *values).drop("edges")


def model_degradation(spark, sf_dir):
    return _rounded(_degradation(_features(spark, sf_dir)), "mae", "mae_ratio")


def retrain_decision(spark, sf_dir):
    features = written(_features(spark, sf_dir), "features")  # drift and errors read one table
    decision = gl.retrain_decision(_drift(features), _degradation(features), 0.001, 1.2)
    return decision.select("should_retrain", F.array_join("reasons", "; ").alias("reasons"))


_QUERIES = [
    sessionize_events,
    sessionize_events_default_gap,
    sessionize_events_short_gap,
    sessionize_orders,
    sessionize_missing_times,
    round_bounds,
    rounds_by_session_window,
    distinct_rounds,
    round_features,
    round_features_of_sessionized,
    round_features_short_gap,
    round_features_missing_times,
    event_type_labels,
    event_type_crosstab,
    event_type_map,
    order_price_levels,
    prev_round_gap,
    target_projection,
    feature_matrix,
    latest_round,
    top_rounds,
    csv_etl_roundtrip,
    rejected_events,
    rounds_without_rejects,
    global_rank,
    time_series_folds,
    fold_mae_closed_form,
    train_cv,
    forecast_batch,
    model_scores,
    demo_run,
    train_cv_stump,
    forecast_stump,
    demo_stump,
    early_stop_stump,
    early_stop_two_features,
    rejected_lines,
    stream_late_events,
    stream_closed_rounds,
    stream_round_features,
    stream_numbered_rounds,
    stream_repaired_rounds,
    etl_in_days,
    feature_drift,
    drift_from_sketches,
    model_degradation,
    retrain_decision,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: what rounds did each user have, and how far from the one before?"""
    return round_features(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = {q.__name__: q for q in _QUERIES}
    if LLM:
        registered |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return registered


# --- SQL ------------------------------------------------------------------


def _marked_sql(source: str, user: str, time: str, key: str, minutes: float) -> str:
    """Events with ``round_index``; ``source`` is a table or a sub-select."""
    gap = int(minutes * 60_000_000)
    win = f"PARTITION BY {user} ORDER BY {time} NULLS LAST, {key}"
    return f"""
      SELECT *, CAST(sum(flag) OVER ({win} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS round_index
      FROM (SELECT *, CASE WHEN prev_ts IS NULL THEN 1
                           WHEN date_diff('microsecond', prev_ts, {time}) > {gap} THEN 1
                           ELSE 0 END AS flag
            FROM (SELECT *, lag({time}) OVER ({win}) AS prev_ts FROM {source} AS src) AS lagged) AS flagged"""


def _sessionize_sql(source: str, user: str, time: str, key: str, minutes: float) -> str:
    whole = f"PARTITION BY {user}, round_index"
    return f"""
      SELECT * EXCLUDE (prev_ts, flag),
             CAST({user} AS VARCHAR) || '_' || CAST(round_index AS VARCHAR) AS round_id,
             min({time}) OVER ({whole}) AS round_start,
             max({time}) OVER ({whole}) AS round_end,
             count({time}) OVER ({whole}) AS event_count
      FROM ({_marked_sql(source, user, time, key, minutes)}) AS marked"""


def _features_sql(
    source: str = "events", minutes: float = GAP, labels: list[str] = LABELS, time: str = TIME
) -> str:
    counts = "".join(
        f", count(CASE WHEN event_type = '{v}' THEN 1 END) AS {v}" for v in labels
    )
    names = "".join(f", {v}" for v in labels)
    in_time = f"PARTITION BY {USER} ORDER BY round_start NULLS LAST, round_index"
    return f"""
      SELECT round_id, {USER}, round_start, round_end, event_count,
             coalesce(date_diff('microsecond', round_start, round_end) / 1e6, CAST(0 AS DOUBLE)) AS duration_seconds{names},
             prev_round_end,
             coalesce(date_diff('microsecond', prev_round_end, round_start) / 1e6, CAST(-1 AS DOUBLE)) AS gap_since_prev_seconds
      FROM (SELECT *, CASE WHEN round_start IS NOT NULL THEN lag(round_end) OVER ({in_time}) END AS prev_round_end
            FROM (SELECT CAST({USER} AS VARCHAR) || '_' || CAST(round_index AS VARCHAR) AS round_id,
                         {USER}, round_index, min({time}) AS round_start, max({time}) AS round_end,
                         count({time}) AS event_count{counts}
                  FROM ({_marked_sql(source, USER, time, 'event_id', minutes)}) AS marked
                  GROUP BY {USER}, round_index) AS rounds) AS lagged"""


def _order_levels_sql() -> str:
    source = """(SELECT o_orderkey AS event_id, o_custkey AS user_id, o_orderdate AS ts,
                        'p' || CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS event_type FROM orders)"""
    features = _features_sql(source, 90 * 24 * 60, LEVELS)
    return f"SELECT * RENAME (user_id AS o_custkey) FROM ({features}) AS f"


def _folds_sql() -> str:
    return f"""
      SELECT ranked.*, k AS fold, CASE WHEN rn < n - (5 - k) * t THEN 'train' ELSE 'test' END AS role
      FROM (SELECT *, row_number() OVER (ORDER BY round_start, round_id) - 1 AS rn,
                   count(*) OVER () AS n, count(*) OVER () // 6 AS t
            FROM ({_features_sql()}) AS feats) AS ranked
      CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS k) AS folds
      WHERE rn < n - (5 - k) * t + t"""


def _drift_sql() -> str:
    parts = []
    for name, limits in EDGES.items():
        bin_no = " + ".join(f"CASE WHEN value >= {e} THEN 1 ELSE 0 END" for e in limits)
        values = f"SELECT round_start >= TIMESTAMP '{SPLIT_AT}' AS cur, CAST({name} AS DOUBLE) AS value FROM feats"
        parts.append(f"""
          SELECT '{name}' AS feature, s.base_rows, s.current_rows, s.base_mean, s.current_mean,
                 s.base_stddev, s.current_stddev,
                 (s.current_mean - s.base_mean) / nullif(s.base_stddev, 0) AS mean_shift,
                 b.stability_index
          FROM (SELECT count(*) FILTER (NOT cur) AS base_rows, count(*) FILTER (cur) AS current_rows,
                       avg(value) FILTER (NOT cur) AS base_mean, avg(value) FILTER (cur) AS current_mean,
                       stddev_pop(value) FILTER (NOT cur) AS base_stddev,
                       stddev_pop(value) FILTER (cur) AS current_stddev
                FROM ({values}) AS v) AS s,
               (SELECT sum((c - b) * ln(c / b)) AS stability_index
                FROM (SELECT CASE WHEN sum(count(*) FILTER (NOT cur)) OVER () > 0 THEN
                                  greatest(count(*) FILTER (NOT cur) / sum(count(*) FILTER (NOT cur)) OVER (), 1e-4) END AS b,
                             CASE WHEN sum(count(*) FILTER (cur)) OVER () > 0 THEN
                                  greatest(count(*) FILTER (cur) / sum(count(*) FILTER (cur)) OVER (), 1e-4) END AS c
                      FROM (SELECT cur, {bin_no} AS bin FROM ({values}) AS v) AS binned
                      GROUP BY bin) AS shares) AS b""")
    return f"WITH feats AS ({_features_sql()}) " + " UNION ALL ".join(parts)


def _sketch_drift_sql() -> str:
    """Exact quantiles: what sketches give as long as a period has no more values than they hold."""
    values = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, date_trunc('day', round_start) >= TIMESTAMP '{SPLIT_AT}' AS cur, CAST({n} AS DOUBLE) AS value FROM feats" for n in EDGES
    )
    return f"""
      WITH feats AS ({_features_sql()}), vals AS ({values}),
           sides AS (SELECT feature, count(*) FILTER (NOT cur) AS base_rows, count(*) FILTER (cur) AS current_rows,
                            avg(value) FILTER (NOT cur) AS base_mean, avg(value) FILTER (cur) AS current_mean,
                            stddev_pop(value) FILTER (NOT cur) AS base_stddev, stddev_pop(value) FILTER (cur) AS current_stddev,
                            list_sort(list(value) FILTER (NOT cur)) AS sorted FROM vals GROUP BY feature),
           edges AS (SELECT feature, k, sorted[ceil(CAST(k AS DOUBLE) / 10 * len(sorted))::BIGINT] AS edge
                     FROM sides, (SELECT unnest(range(1, 10)) AS k) AS ks),
           ranks AS (SELECT feature, k, count(*) FILTER (NOT cur AND value <= edge) / count(*) FILTER (NOT cur) AS b,
                            count(*) FILTER (cur AND value <= edge) / count(*) FILTER (cur) AS c
                     FROM edges JOIN vals USING (feature) GROUP BY feature, k
                     UNION ALL SELECT feature, 10, 1, 1 FROM sides),
           shares AS (SELECT feature, greatest(b - coalesce(lag(b) OVER f, 0), 1e-4) AS b, greatest(c - coalesce(lag(c) OVER f, 0), 1e-4) AS c
                      FROM ranks WINDOW f AS (PARTITION BY feature ORDER BY k)),
           indexes AS (SELECT feature, sum((c - b) * ln(c / b)) AS stability_index FROM shares GROUP BY feature)
      SELECT feature, base_rows, current_rows, round(base_mean, 6) AS base_mean, round(current_mean, 6) AS current_mean,
             round(base_stddev, 6) AS base_stddev, round(current_stddev, 6) AS current_stddev,
             round((current_mean - base_mean) / nullif(base_stddev, 0), 6) AS mean_shift, round(stability_index, 6) AS stability_index
      FROM sides JOIN indexes USING (feature)"""


def _degradation_sql() -> str:
    return f"""
      SELECT date_trunc('day', round_start)::TIMESTAMP AS period, count(*) AS rows,
             avg(abs(event_count - (1 + duration_seconds / 7200))) AS mae,
             avg(abs(event_count - (1 + duration_seconds / 7200))) / {BASELINE_MAE} AS mae_ratio
      FROM ({_features_sql()}) AS feats GROUP BY 1"""


def _closed_sql() -> str:
    gap_and_delay = int((GAP + 10) * 60)
    labels = ", ".join(LABELS)
    return f"""
      SELECT {USER}, round_start, round_end, event_count, {labels}
      FROM ({_features_sql()}) AS feats
      WHERE round_end + INTERVAL {gap_and_delay} SECOND <= (SELECT max({TIME}) FROM events)"""


def _stump_sql(target: str) -> str:
    """Error per fold of the mean target of rounds with one event and of rounds with more."""
    return f"""
      SELECT fold, avg(abs(y - mean)) AS mae
      FROM (SELECT *, {target} AS y, event_count > 1 AS busy FROM ({_folds_sql()}) AS f) AS tested
      JOIN (SELECT fold, event_count > 1 AS busy, avg({target}) AS mean FROM ({_folds_sql()}) AS f
            WHERE role = 'train' GROUP BY fold, busy) AS means USING (fold, busy)
      WHERE role = 'test' GROUP BY fold"""


def oracle_sql() -> dict[str, str]:
    statements = _engine_sql()
    if LLM:
        statements |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements


def _engine_sql() -> dict[str, str]:
    features = _features_sql()
    holed = (
        "(SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN ts END AS ts, "
        "event_type FROM events)"
    )
    damaged = """(SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id, ts, event_type
                  FROM events WHERE event_type NOT IN ('error', 'signup'))"""
    labels = ", ".join(LABELS)
    matrix = ", ".join(f"CAST({c} AS DOUBLE) AS x_{c}" for c in FEATURES)
    rounded = "round(base_mean, 6) AS base_mean, round(current_mean, 6) AS current_mean, "
    rounded += "round(base_stddev, 6) AS base_stddev, round(current_stddev, 6) AS current_stddev, "
    rounded += "round(mean_shift, 6) AS mean_shift, round(stability_index, 6) AS stability_index"
    return {
        "sessionize_events": _sessionize_sql("events", USER, TIME, "event_id", GAP),
        "sessionize_events_default_gap": _sessionize_sql("events", USER, TIME, "event_id", 30),
        "sessionize_events_short_gap": _sessionize_sql("events", USER, TIME, "event_id", 0.5),
        "sessionize_orders": _sessionize_sql(
            "orders", "o_custkey", "o_orderdate", "o_orderkey", 90 * 24 * 60
        ),
        "sessionize_missing_times": f"""
            SELECT * REPLACE (CASE WHEN ts IS NOT NULL THEN event_id END AS event_id)
            FROM ({_sessionize_sql(holed, USER, TIME, "event_id", GAP)}) AS s""",
        "round_bounds": f"SELECT round_id, user_id, round_start, round_end, event_count FROM ({features}) AS f",
        "rounds_by_session_window": f"SELECT user_id, round_start, round_end, event_count FROM ({features}) AS f",
        "distinct_rounds": f"""
            SELECT count(DISTINCT round_id) AS rounds
            FROM ({_sessionize_sql("events", USER, TIME, "event_id", GAP)}) AS s""",
        "round_features": features,
        "round_features_of_sessionized": features,
        "round_features_short_gap": _features_sql(minutes=0.5),
        "round_features_missing_times": _features_sql(holed),
        "event_type_labels": """
            SELECT row_number() OVER (ORDER BY label) - 1 AS position, label
            FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL) AS d""",
        "event_type_crosstab": f"SELECT round_id, {labels} FROM ({features}) AS f",
        "event_type_map": f"""
            WITH marked AS ({_marked_sql("events", USER, TIME, "event_id", GAP)}),
                 counts AS (SELECT user_id, round_index, event_type, count(*) AS n FROM marked GROUP BY ALL)
            SELECT CAST(user_id AS VARCHAR) || '_' || CAST(round_index AS VARCHAR) AS round_id, user_id,
                   coalesce(string_agg(event_type || '=' || n, ',' ORDER BY event_type) FILTER (event_type IS NOT NULL), '') AS label_counts
            FROM counts GROUP BY user_id, round_index""",
        "order_price_levels": _order_levels_sql(),
        "prev_round_gap": f"SELECT round_id, prev_round_end, gap_since_prev_seconds FROM ({features}) AS f",
        "target_projection": f"SELECT round_id, event_count * CAST(0.1 AS DOUBLE) AS target FROM ({features}) AS f",
        "feature_matrix": f"""
            SELECT round_id, event_count * CAST(0.1 AS DOUBLE) AS label, {matrix}
            FROM ({features}) AS f""",
        "latest_round": f"""
            SELECT * FROM ({features}) AS f
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round_start DESC, round_id DESC) = 1""",
        "top_rounds": f"""
            SELECT round_id, duration_seconds, event_count FROM ({features}) AS f
            ORDER BY duration_seconds DESC, round_id LIMIT 20""",
        "csv_etl_roundtrip": features,
        "rejected_events": """
            SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
                   CASE WHEN event_type = 'signup' THEN 'at ' ELSE '' END || CAST(ts AS VARCHAR) AS recorded_at,
                   CASE WHEN event_type = 'error' THEN 'null user' ELSE 'malformed time' END AS reject_reason
            FROM events WHERE event_type IN ('error', 'signup')""",
        "rounds_without_rejects": f"""
            SELECT round_id, event_count, duration_seconds, gap_since_prev_seconds
            FROM ({_features_sql(damaged)}) AS f""",
        "global_rank": f"""
            SELECT round_id, row_number() OVER (ORDER BY round_start, round_id) - 1 AS rn
            FROM ({features}) AS f""",
        "time_series_folds": f"SELECT round_id, rn, fold, role FROM ({_folds_sql()}) AS f",
        "fold_mae_closed_form": f"""
            WITH folds AS ({_folds_sql()}),
                 lines AS (SELECT fold, regr_slope(duration_seconds, event_count) AS slope,
                                  regr_intercept(duration_seconds, event_count) AS intercept
                           FROM folds WHERE role = 'train' GROUP BY fold)
            SELECT fold, round(avg(abs(duration_seconds - (slope * event_count + intercept))), 6) AS mae
            FROM folds JOIN lines USING (fold) WHERE role = 'test' GROUP BY fold""",
        "train_cv_stump": f"""
            WITH maes AS ({_stump_sql("duration_seconds")})
            SELECT fold, round(mae, 6) AS mae, round(avg(mae) OVER (), 6) AS cv_mae_mean FROM maes""",
        "forecast_stump": f"""
            WITH folds AS ({_folds_sql()}),
                 groups AS (SELECT event_count > 1 AS busy, avg(duration_seconds) AS mean FROM folds
                            WHERE fold = 4 AND role = 'train' GROUP BY busy),
                 latest AS (SELECT * FROM ({features}) AS f
                            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round_start DESC, round_id DESC) = 1)
            SELECT CAST(user_id AS VARCHAR) AS entity_id, 3 AS horizon, '0.5' AS key, round(mean, 6) AS prediction, true AS own_model
            FROM latest JOIN groups ON busy = (event_count > 1)""",
        "demo_stump": f"""
            WITH train AS (SELECT event_count AS x, event_count * CAST(0.1 AS DOUBLE) AS y FROM ({_folds_sql()}) AS f WHERE fold = 4 AND role = 'train'),
                 groups AS (SELECT x, count(*) AS n, sum(y) AS s FROM train GROUP BY x),
                 sides AS (SELECT x, sum(n) OVER upto AS n, sum(s) OVER upto AS s, sum(n) OVER () AS all_n, sum(s) OVER () AS all_s
                           FROM groups WINDOW upto AS (ORDER BY x)),
                 best AS (SELECT x AS cut, s / n AS low, (all_s - s) / (all_n - n) AS high FROM sides WHERE n < all_n
                          ORDER BY s * s / n + (all_s - s) * (all_s - s) / (all_n - n) DESC LIMIT 1),
                 latest AS (SELECT * FROM ({features}) AS f
                            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round_start DESC, round_id DESC) = 1)
            SELECT CAST(user_id AS VARCHAR) AS entity_id, 1 AS horizon, '0.5' AS key,
                   round(CASE WHEN event_count <= cut THEN low ELSE high END, 6) AS prediction, true AS own_model
            FROM latest, best""",
        "early_stop_two_features": f"""
            WITH rows AS (SELECT fold, role, event_count > 1 AS busy, hour(round_start) < 12 AS morning,
                                 CASE WHEN event_count > 1 THEN 10 ELSE 0 END + CASE WHEN hour(round_start) < 12 THEN 1 ELSE 0 END
                                 + event_count % 3 * CAST(0.25 AS DOUBLE) AS y FROM ({_folds_sql()}) AS f),
                 firsts AS (SELECT fold, busy, avg(y) AS m FROM rows WHERE role = 'train' GROUP BY fold, busy),
                 rests AS (SELECT fold, morning, avg(y - m) AS r FROM rows JOIN firsts USING (fold, busy) WHERE role = 'train' GROUP BY fold, morning),
                 sizes AS (SELECT unnest(range(1, {BOOSTED + 1})) AS k),
                 maes AS (SELECT fold, k, avg(abs(y - m - r * (1 - pow(CAST(0.9 AS DOUBLE), k - 1)))) AS mae
                          FROM rows JOIN firsts USING (fold, busy) JOIN rests USING (fold, morning), sizes WHERE role = 'test' GROUP BY fold, k),
                 best AS (SELECT fold, mae, k::INTEGER AS best_iteration FROM maes QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mae, k) = 1)
            SELECT fold, round(mae, 6) AS mae, best_iteration, max_by(best_iteration, fold) OVER () AS trees FROM best""",
        "early_stop_stump": f"""
            WITH maes AS ({_stump_sql("CASE WHEN event_count > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")})
            SELECT fold, round(mae, 6) AS mae, 1 AS best_iteration, 1 AS trees FROM maes""",
        "rejected_lines": """
            SELECT 'malformed line' AS reject_reason, count(*) AS lines, count(*) AS kept
            FROM events WHERE event_type IN ('error', 'signup')""",
        "stream_late_events": f"""
            SELECT user_id, event_count, {labels}
            FROM ({_features_sql("(SELECT * FROM events WHERE event_type <> 'view')")}) AS f""",
        "stream_closed_rounds": _closed_sql(),
        "stream_repaired_rounds": features,
        "etl_in_days": features,
        "stream_numbered_rounds": f"""
            SELECT * FROM ({features}) AS f
            WHERE round_end + INTERVAL {int((GAP + 10) * 60)} SECOND <= (SELECT max(ts) FROM events)""",
        "stream_round_features": f"""
            SELECT * FROM ({features}) AS f
            WHERE round_end + INTERVAL {int((GAP + 10) * 60)} SECOND <= (SELECT max(ts) FROM events)""",
        "feature_drift": f"""
            SELECT feature, base_rows, current_rows, {rounded} FROM ({_drift_sql()}) AS d""",
        "drift_from_sketches": _sketch_drift_sql(),
        "model_degradation": f"""
            SELECT period, rows, round(mae, 6) AS mae, round(mae_ratio, 6) AS mae_ratio
            FROM ({_degradation_sql()}) AS d""",
        "retrain_decision": f"""
            SELECT count(*) > 0 AS should_retrain,
                   coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reasons
            FROM (SELECT 'drift: ' || feature AS reason FROM ({_drift_sql()}) AS d
                  WHERE stability_index > 0.001
                  UNION ALL
                  SELECT 'error' AS reason FROM (SELECT max_by(mae_ratio, period) AS ratio
                                                 FROM ({_degradation_sql()}) AS g) AS m
                  WHERE ratio > 1.2) AS reasons""",
    }
