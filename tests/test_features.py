import random
from datetime import datetime, timedelta

import brute
import pytest
from pyspark.sql import functions as F

import gapline as gl
from gapline.operators.cells import CellSpec, build_cells
from gapline.operators.features import packed_cells

T0 = datetime(2024, 1, 1, 9)

SAMPLE = [
    ("user_1", "2026-08-28T09:00:00Z", "click", 1.0),
    ("user_1", "2026-08-28T09:01:00Z", "click", 1.0),
    ("user_1", "2026-08-28T09:02:00Z", "submit", 1.0),
    ("user_1", "2026-08-28T10:30:00Z", "click", 1.0),
    ("user_2", "2026-08-28T11:00:00Z", "click", 1.0),
    ("user_2", "2026-08-28T11:45:00Z", "submit", 1.0),
]
SAMPLE_SCHEMA = "user_id string, recorded_at string, event_type string, value double"


def clock(text):
    return datetime.fromisoformat(f"2026-08-28T{text}")


# round, start, end, count, duration, click, submit, previous end, gap
GOLDEN = [
    ("user_1_1", clock("09:00"), clock("09:02"), 3, 120.0, 2, 1, None, -1.0),
    ("user_1_2", clock("10:30"), clock("10:30"), 1, 0.0, 1, 0, clock("09:02"), 5280.0),
    ("user_2_1", clock("11:00"), clock("11:00"), 1, 0.0, 1, 0, None, -1.0),
    ("user_2_2", clock("11:45"), clock("11:45"), 1, 0.0, 0, 1, clock("11:00"), 2700.0),
]


def golden_rows(features):
    return [tuple(r) for r in features.drop("user_id").orderBy("round_id").collect()]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, SAMPLE_SCHEMA)


def test_golden(sample):
    fused = gl.round_features(sample)
    assert golden_rows(fused) == GOLDEN
    two_step = gl.compute_round_features(gl.sessionize(sample))
    assert golden_rows(two_step) == GOLDEN
    assert fused.dtypes == two_step.dtypes
    assert fused.dtypes == [
        ("round_id", "string"), ("user_id", "string"), ("round_start", "timestamp"),
        ("round_end", "timestamp"), ("event_count", "bigint"), ("duration_seconds", "double"),
        ("click", "bigint"), ("submit", "bigint"), ("prev_round_end", "timestamp"),
        ("gap_since_prev_seconds", "double"),
    ]


def test_round_bounds(sample):
    bounds = gl.round_bounds(gl.sessionize(sample)).orderBy("round_id").collect()
    assert [(r.round_id, r.round_start, r.round_end, r.event_count) for r in bounds] == [
        g[:4] for g in GOLDEN
    ]


def test_without_event_types(sample):
    plain = sample.drop("event_type")
    for features in (gl.round_features(plain), gl.compute_round_features(gl.sessionize(plain))):
        assert [c for c in features.columns if c in ("click", "submit")] == []
        assert features.count() == 4


def test_null_event_type_counts_as_event_only(spark):
    data = [("u", "2026-08-28T09:00:00Z", None, 1.0), ("u", "2026-08-28T09:01:00Z", "click", 1.0)]
    row = gl.round_features(spark.createDataFrame(data, SAMPLE_SCHEMA)).first()
    assert (row.event_count, row.click) == (2, 1)
    assert "null" not in row.asDict()


def test_given_labels_and_prefix(sample):
    row = gl.round_features(sample, labels=["submit", "other"], prefix="n_").orderBy("round_id").first()
    assert (row.n_submit, row.n_other) == (1, 0)
    assert "n_click" not in row.asDict()


def test_labels_must_not_collide(spark):
    data = [("u", "2026-08-28T09:00:00Z", "event_count", 1.0)]
    df = spark.createDataFrame(data, SAMPLE_SCHEMA)
    with pytest.raises(ValueError, match="collide"):
        gl.round_features(df)
    with pytest.raises(ValueError, match="collide"):
        gl.compute_round_features(gl.sessionize(df))
    assert gl.round_features(df, prefix="n_").first().n_event_count == 1


def test_odd_label_names(spark, tmp_path):
    names = ["a b", "x.y", "cell", "`q`", "label_1", "label", "n"]
    data = [("u", "2026-08-28T09:00:00Z", n, 1.0) for n in names]
    df = spark.createDataFrame(data, SAMPLE_SCHEMA)
    gl.write_features(gl.round_features(df), str(tmp_path / "f"))
    written = gl.read_features(spark, str(tmp_path / "f"))
    assert written.columns[6:-2] == sorted(names)
    assert set(written.first()[6:-2]) == {1}
    two_step = gl.compute_round_features(gl.sessionize(df))
    assert two_step.columns == written.columns and two_step.collect() == written.collect()


def test_too_many_labels(spark, sample):
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError, match="more than 1"):
            gl.round_features(sample)
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)


def test_custom_names(sample):
    renamed = sample.withColumnsRenamed({"user_id": "device", "recorded_at": "at"})
    fused = gl.round_features(renamed, "device", "at")
    two_step = gl.compute_round_features(gl.sessionize(renamed, "device", "at"), "device", ts_col="at")
    for features in (fused, two_step):
        assert golden_rows(features.withColumnRenamed("device", "user_id")) == GOLDEN


def test_latest_rounds(sample):
    latest = gl.latest_rounds(gl.round_features(sample))
    assert sorted(r.round_id for r in latest.collect()) == ["user_1_2", "user_2_2"]


@pytest.mark.parametrize("gap", [0.5, 30, 240])
def test_fused_and_two_step_agree(events, gap):
    fused = gl.round_features(events, ts_col="ts", gap_minutes=gap)
    sessionized = gl.sessionize(events, ts_col="ts", gap_minutes=gap)
    two_step = gl.compute_round_features(sessionized, ts_col="ts", gap_minutes=gap)
    assert fused.count() == two_step.count()
    assert fused.exceptAll(two_step).isEmpty()


def test_many_event_types_are_packed_before_users_are_gathered(spark):
    """Rows that enter the window over users: cells, not cells times event types."""
    labels = [f"t{k}" for k in range(1000)]
    rows = [(f"u{k % 3}", T0 + timedelta(minutes=k % 50, hours=6 * (k % 2)), labels[k * 7 % 1000]) for k in range(3000)]
    events = spark.createDataFrame(rows, "user_id string, recorded_at timestamp, event_type string")
    spec = CellSpec("user_id", "recorded_at", 30 * 60 * 10**6)
    split = build_cells(events, spec, F.col("event_type")).count()
    cells = build_cells(events, spec).count()
    packed = packed_cells(build_cells(events, spec, F.col("event_type")), spec)
    assert packed.count() == cells < split / 100
    plan = gl.round_features(events, labels=labels, missing_times=False)._jdf.queryExecution().executedPlan().toString()
    # The window sits right on the packing aggregate: no other exchange, and no rows by label.
    window = plan.index("Window")
    assert "map_from_entries" in plan[window:] or "collect_list" in plan[window:]
    assert plan.count("Exchange hashpartitioning(user") == 2


@pytest.mark.parametrize("gap", [30, 0.5])
def test_packed_counts_equal_plain_ones(spark, gap):
    draw = random.Random(gap)
    labels = [f"t{k:02}" for k in range(17)]  # sorted: the first untimed event joins the last round
    rows = [
        (draw.choice(["u", "v", None]), draw.choice([T0 + timedelta(minutes=draw.randrange(400)), None]), draw.choice([*labels, "zz, not listed", None]))
        for _ in range(150)
    ]
    events = spark.createDataFrame(rows, "user_id string, recorded_at timestamp, event_type string")
    got = {r.round_id: r.asDict() for r in gl.round_features(events, gap_minutes=gap, labels=labels, missing_times=True).collect()}
    want = {r["round_id"]: r for r in brute.rounds(rows, gap)}
    assert got.keys() == want.keys()
    for name, row in got.items():
        assert row == {k: want[name].get(k, 0) for k in row}


def test_label_maps(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["u", "v", None]), draw.choice([T0 + timedelta(minutes=draw.randrange(2000)), None]), draw.choice(["a", "B", "b", "", None])) for _ in range(200)]
    rows += [("w", T0, None), ("w", T0, None)]
    events = spark.createDataFrame(rows, "user_id string, recorded_at timestamp, event_type string")
    timed = [r for r in rows if r[1] is not None]
    want = {}
    for r in brute.rounds(timed, 30):
        want[r["round_id"]] = {v: r[v] for v in ("a", "B", "b", "") if r.get(v)}
    got = {r.round_id: r.label_counts for r in gl.label_maps(events).collect()}
    assert got == want and got["w_1"] == {}
    assert gl.label_maps(events.limit(0)).isEmpty()
