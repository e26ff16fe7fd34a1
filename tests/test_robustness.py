"""Inputs, folders and sessions other than the usual ones."""

import glob
import os
import shutil
import subprocess
import sys
from datetime import datetime, timedelta

import __spark_entry__ as entry
import gapline as gl
import pytest
from conftest import TESTDATA
from gapline.operators.rank import with_rank_parts
from gapline.schema import RECORDINGS_SCHEMA
from gapline.sources import scratch
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

HEADER = "user_id,recorded_at,event_type,value"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_stream_reads_a_table_in_many_files(spark, tmp_path):
    spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = entry.stream_closed_rounds(spark, f"{TESTDATA}/sf0.001").count()
    assert entry.stream_closed_rounds(spark, str(tmp_path)).count() == want == 688


def stream_csv(spark, tmp_path, lines):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    query = gl.stream_rounds(spark, str(folder), RECORDINGS_SCHEMA, str(tmp_path / "out"), str(tmp_path / "state"), fmt="csv")
    query.awaitTermination()
    return query


def test_csv_in_a_stream_follows_the_batch_rules(spark, tmp_path):
    rows = ["u,2024-01-01 09:00:00,a,1", "NA,2024-01-01 09:00:00,a,1", "u,2024-01-02 09:00:00,a,NA"]
    progress = stream_csv(spark, tmp_path, [HEADER, *rows[:2]]).recentProgress
    assert sum(p["observedMetrics"]["rejects"]["null_user"] for p in progress if p["numInputRows"]) == 1


@pytest.mark.parametrize("lines", [["recorded_at,user_id,event_type,value", "2024-01-01,u,a,1"], [HEADER, "u,2024-01-01,a,1,extra"], [HEADER, "u,2024-01-01,a,oops"]])
def test_csv_that_does_not_fit_fails_a_stream(spark, tmp_path, lines):
    with pytest.raises(PySparkException):
        stream_csv(spark, tmp_path, lines)


@pytest.mark.parametrize("line", ["u,2024-01-01 09:00:00,a,1,extra", "u,2024-01-01 09:00:00", "u,2024-01-01 09:00:00,a,oops"])
def test_malformed_lines_fail_or_are_set_aside(spark, tmp_path, line):
    path = tmp_path / "r.csv"
    path.write_text("\n".join([HEADER, "u,2024-01-01 09:00:00,a,1", line, "u,at noon,a,1"]) + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        gl.read_recordings(spark, str(path), RECORDINGS_SCHEMA).select("user_id").collect()
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    for schema in (None, RECORDINGS_SCHEMA):
        features = gl.run_etl(spark, str(path), out, schema=schema, rejects=rejects)
    assert [r.event_count for r in features.collect()] == [1]
    got = {r.reject_reason: r for r in spark.read.parquet(rejects).collect()}
    assert sorted(got) == ["malformed line", "malformed time"]
    assert got["malformed line"].malformed_line == line and got["malformed time"].recorded_at == "at noon"


def test_times_in_another_format(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(f"{HEADER}\nu,08/28/2026 09:00,a,1\n")
    features = gl.run_etl(spark, str(path), str(tmp_path / "out"), schema=RECORDINGS_SCHEMA, time_format="MM/dd/yyyy HH:mm")
    assert features.first().round_start == datetime(2026, 8, 28, 9)
    with pytest.raises(PySparkException):
        gl.run_etl(spark, str(path), str(tmp_path / "out2"), schema=RECORDINGS_SCHEMA)


def test_ignore_skips_only_what_is_there(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "r.csv").write_text(f"{HEADER}\nu,2024-01-01 09:00,a,1\n")
    run = {"schema": RECORDINGS_SCHEMA, "mode": "ignore"}
    with pytest.raises(PySparkException):  # a folder without a table
        gl.run_etl(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), **run)
    assert gl.run_etl(spark, str(tmp_path / "r.csv"), str(tmp_path / "new"), **run).count() == 1


def test_a_stream_counts_instants_whatever_the_zone(spark, tmp_path):
    start = datetime(2024, 3, 10, 1, 30)  # the clock in New York is about to skip an hour
    rows = [(1, start, "a"), (1, start + timedelta(minutes=105), "a"), (1, start + timedelta(days=9), "a"), (2, start + timedelta(days=9), "a")]
    spark.createDataFrame(rows, "user_id long, recorded_at timestamp_ntz, event_type string").write.parquet(str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        query = gl.stream_rounds(spark, str(tmp_path / "in"), "user_id long, recorded_at timestamp_ntz, event_type string", str(tmp_path / "out"), str(tmp_path / "state"), gap_minutes=60)
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels_that_differ_by_case_are_an_error(spark):
    rows = [(1, datetime(2024, 1, 1), "Click"), (1, datetime(2024, 1, 1), "click")]
    events = spark.createDataFrame(rows, "user_id long, recorded_at timestamp, event_type string")
    with pytest.raises(ValueError, match="Click.*click"):
        gl.round_features(events)
    with pytest.raises(ValueError, match="Round_ID"):
        gl.round_features(events, labels=["Round_ID"])


def test_input_columns_may_be_called_like_helpers(spark):
    rows = [(1, datetime(2024, 1, 1), "x"), (1, None, "y"), (1, None, "z")]
    schema = "user_id long, recorded_at timestamp, _user string"
    events = spark.createDataFrame(rows, schema)
    for name in ("_cell", "_event_cell", "_rank", "_first"):
        events = events.withColumn(name, F.col("_user"))
    got = gl.sessionize(events)
    assert got.count() == 3 and {r._user for r in got.collect()} == {"x", "y", "z"}


def test_total_drift_triggers_the_decision(spark):
    day = [datetime(2024, 1, n) for n in (1, 2)]
    rows = [(day[0], 1.0, 0.0)] * 10 + [(day[1], 9.0, 0.0)] * 10
    table = spark.createDataFrame(rows, "round_start timestamp, x double, z double")
    drift = gl.feature_drift(table, "2024-01-02", {"x": [5.0], "z": [5.0]})
    assert {r.feature: r.stability_index > 5 for r in drift.collect()} == {"x": True, "z": False}
    calm = spark.createDataFrame([(day[0], 0.1, 1.0)], "period timestamp, mae double, mae_ratio double")
    decision = gl.retrain_decision(drift, calm).first()
    assert decision.should_retrain and decision.reasons == ["drift: x"]
    empty = gl.feature_drift(table, "2025-01-01", {"x": [5.0]})
    assert gl.retrain_decision(empty, calm).first().reasons == ["no data: x"]


def test_fold_filters_reach_the_scan(spark):
    table = spark.range(10_000).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked, parts = with_rank_parts(table, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts.rows == 10_000 and len(parts.parts) > 2
    for low, high in [(0, 10), (4000, 6000), (9_990, 10_000), (0, 10_000)]:
        window = ranked.where(parts.holding(low, high) & (F.col("rn") >= low) & (F.col("rn") < high))
        assert [window.count(), window.agg(F.min("k"), F.max("k")).first()] == [high - low, (low, high - 1)]
    plan = ranked.where(parts.holding(0, 10))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rank_part" in plan and "LessThanOrEqual(rank_part" in plan


def test_intermediates_are_deleted(spark, tmp_path):
    scratch_root = f"{scratch.scratch_dir(spark).removeprefix('file:')}/gapline"
    (tmp_path / "r.csv").write_text(HEADER + "\n" + "".join(f"u{k % 9},2024-01-{1 + k % 27:02} 09:{k % 60:02}:00,a,1\n" for k in range(400)))
    before = set(glob.glob(f"{scratch_root}/*"))
    features = gl.run_etl(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), schema=RECORDINGS_SCHEMA)
    training = {"max_iter": 1, "max_depth": 1, "min_rows": 1}
    gl.train_baseline(gl.add_target(features), "target", str(tmp_path / "model"), **training)
    assert set(glob.glob(f"{scratch_root}/*")) == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir.*scratch"):
        scratch.scratch_dir(Session())


@pytest.mark.parametrize("argument", ["", "scratch='{folder}'"])
def test_a_session_of_its_own(tmp_path, argument):
    """Without a folder set anywhere, one machine makes one; with ``scratch`` that is used."""
    code = f"""
import gapline as gl
from gapline.sources.scratch import scratch_dir
spark = gl.make_session(master="local[1]", conf={{"spark.ui.enabled": "false"}}, {argument.format(folder=tmp_path)})
ranked, rows = gl.with_global_rank(spark.range(10), ["id"])
print("ROWS", rows, ranked.count(), scratch_dir(spark))
"""
    empty = tmp_path / "conf"
    empty.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(empty), "PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 10 10" in done.stdout, done.stderr[-2000:]
    assert not argument or str(tmp_path) in done.stdout


def test_the_engine_stands_alone(tmp_path):
    """Without the training-data subpackage the entry still imports and registers its own queries."""
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests", "__pycache__")
    shutil.copytree(REPO, copy, ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("False"), done.stderr[-2000:]
