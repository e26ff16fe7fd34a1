import glob

import pytest
from pyspark.errors import PySparkException
from test_features import GOLDEN, SAMPLE, golden_rows

import gapline as gl
from gapline.schema import RECORDINGS_SCHEMA


@pytest.fixture
def csv_file(tmp_path):
    def write(rows, name="recordings.csv", header="user_id,recorded_at,event_type,value"):
        path = tmp_path / name
        path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n")
        return str(path)

    return write


@pytest.mark.parametrize("schema", [None, RECORDINGS_SCHEMA])
def test_csv_to_parquet(spark, csv_file, tmp_path, schema):
    out = str(tmp_path / "features")
    features = gl.run_etl(spark, csv_file(SAMPLE), out, schema=schema)
    assert golden_rows(features) == GOLDEN
    assert dict(gl.read_features(spark, out).dtypes)["prev_round_end"] == "timestamp"
    # A second run overwrites.
    assert golden_rows(gl.run_etl(spark, csv_file(SAMPLE), out, schema=schema)) == GOLDEN


def test_single_scan_with_labels_given(spark, csv_file, tmp_path):
    features = gl.run_etl(
        spark, csv_file(SAMPLE), str(tmp_path / "f"), schema=RECORDINGS_SCHEMA,
        labels=["click", "submit"], missing_times=False,
    )
    assert golden_rows(features) == GOLDEN


def test_untimed_recordings(spark, csv_file, tmp_path):
    rows = SAMPLE + [("user_1", "", "click", 1), ("user_1", "NA", "submit", 1)]
    features = gl.run_etl(spark, csv_file(rows), str(tmp_path / "f"), schema=RECORDINGS_SCHEMA)
    got = {r.round_id: (r.event_count, r.click, r.submit) for r in features.collect()}
    assert got["user_1_2"] == (1, 2, 0)
    assert got["user_1_3"] == (0, 0, 1)


def test_existing_output_is_kept_on_request(spark, csv_file, tmp_path):
    out = str(tmp_path / "features")
    gl.run_etl(spark, csv_file(SAMPLE), out, mode="ignore")
    again = gl.run_etl(spark, csv_file(SAMPLE[:1], "other.csv"), out, mode="ignore")
    assert golden_rows(again) == GOLDEN


def test_bad_rows_fail_or_are_set_aside(spark, csv_file, tmp_path):
    bad = [("", "2026-08-28T09:00:00Z", "click", 1), ("user_1", "junk", "click", 1)]
    for row in bad:
        with pytest.raises(PySparkException):
            gl.run_etl(spark, csv_file([*SAMPLE, row]), str(tmp_path / "x"), schema=RECORDINGS_SCHEMA)
    out, rejects = str(tmp_path / "ok"), str(tmp_path / "rejects")
    features = gl.run_etl(
        spark, csv_file(SAMPLE + bad), out, schema=RECORDINGS_SCHEMA, rejects=rejects
    )
    assert golden_rows(features) == GOLDEN
    reasons = [r.reject_reason for r in spark.read.parquet(rejects).collect()]
    assert sorted(reasons) == ["malformed time", "null user"]


def test_custom_columns(spark, csv_file, tmp_path):
    source = csv_file(SAMPLE, header="device,at,event_type,value")
    features = gl.run_etl(spark, source, str(tmp_path / "f"), user_col="device", ts_col="at")
    assert golden_rows(features.withColumnRenamed("device", "user_id")) == GOLDEN


def test_parquet_source_and_sorted_sink(spark, events, tmp_path):
    out = str(tmp_path / "sorted")
    gl.write_features(gl.round_features(events, ts_col="ts"), out, sort_by=["user_id", "round_start"])
    for path in glob.glob(f"{out}/*.parquet"):
        rows = [(r.user_id, r.round_start) for r in spark.read.parquet(path).collect()]
        assert rows == sorted(rows)
    with pytest.raises(ValueError, match="format"):
        gl.read_recordings(spark, out, fmt="xml")


def test_tables_by_user_are_read_without_a_shuffle(spark, events):
    features = gl.round_features(events, ts_col="ts", gap_minutes=240)
    spark.sql("drop table if exists features_by_user")
    table = gl.save_by_user(features, "features_by_user", "user_id", buckets=4)
    try:
        latest = gl.latest_rounds(table)
        plan = latest._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert "Exchange" in gl.latest_rounds(features)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, gl.latest_rounds(features).collect()))
    finally:
        spark.sql("drop table features_by_user")
