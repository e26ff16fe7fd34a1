from datetime import datetime, timedelta

import brute
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import gapline as gl

T0 = datetime(2024, 3, 1, 9)
SCHEMA = "user_id string, recorded_at timestamp, event_type string"
GAPS = [0, 0.001, 0.5, 1, 30]


def at(**delta):
    return T0 + timedelta(**delta)


def rows(df, *cols, order=("user_id", "recorded_at")):
    return [tuple(r) for r in df.select(*cols).orderBy(*order).collect()]


def test_minimal_strings(spark):
    data = [
        ("u1", "2026-08-28T09:00:00Z"),
        ("u1", "2026-08-28T09:05:00Z"),
        ("u1", "2026-08-28T10:00:00Z"),
        ("u2", "2026-08-28T09:00:00Z"),
        ("u2", "2026-08-28T11:00:00Z"),
    ]
    df = spark.createDataFrame(data, "user_id string, recorded_at string")
    out = gl.sessionize(df, gap_minutes=30)
    assert out.columns == [
        "user_id", "recorded_at", "round_index", "round_id",
        "round_start", "round_end", "event_count",
    ]
    assert rows(out, "round_id", "event_count") == [
        ("u1_1", 2), ("u1_1", 2), ("u1_2", 1), ("u2_1", 1), ("u2_2", 1),
    ]
    types = dict(out.dtypes)
    assert (types["round_index"], types["event_count"]) == ("bigint", "bigint")
    assert types["round_start"] == types["recorded_at"] == "timestamp"
    assert out.select(F.countDistinct("round_id")).first()[0] == 4


def test_boundary_is_strict(spark):
    data = [("u", T0, "a"), ("u", at(minutes=30), "a"), ("u", at(minutes=60, microseconds=1), "a")]
    out = gl.sessionize(spark.createDataFrame(data, SCHEMA))
    assert rows(out, "round_index") == [(1,), (1,), (2,)]


def test_zero_gap_joins_only_equal_times(spark):
    data = [("u", T0, "a"), ("u", T0, "b"), ("u", at(microseconds=1), "a")]
    out = gl.sessionize(spark.createDataFrame(data, SCHEMA), gap_minutes=0)
    assert rows(out, "round_index", "event_count") == [(1, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize("gap", GAPS)
def test_missing_times(spark, gap):
    data = [("u", T0, "a"), ("u", None, "b"), ("u", None, "c"), ("v", None, "d")]
    out = gl.sessionize(spark.createDataFrame(data, SCHEMA), gap_minutes=gap)
    got = rows(out, "event_type", "round_id", "round_start", "event_count", order=["event_type"])
    assert got == [
        ("a", "u_1", T0, 1),
        ("b", "u_1", T0, 1),
        ("c", "u_2", None, 0),
        ("d", "v_1", None, 0),
    ]


def test_users_without_name_are_left_out_and_rejected(spark):
    data = [("u", T0, "a"), (None, T0, "b")]
    df = spark.createDataFrame(data, SCHEMA)
    assert gl.sessionize(df).count() == 1
    good, bad = gl.split_rejects(df)
    assert good.count() == 1
    assert [(r.event_type, r.reject_reason) for r in bad.collect()] == [("b", "null user")]


def test_malformed_time(spark):
    data = [("u", "2024-03-01 09:00:00"), ("u", "junk"), ("u", "")]
    df = spark.createDataFrame(data, "user_id string, recorded_at string")
    with pytest.raises(PySparkException, match="not a timestamp: junk"):
        gl.sessionize(df, missing_times=False).collect()
    good, bad = gl.split_rejects(df)
    assert [(r.recorded_at, r.reject_reason) for r in bad.collect()] == [("junk", "malformed time")]
    assert gl.sessionize(good).count() == 2


def test_other_kinds_of_time(spark):
    nanos = 1_709_283_600_000_000_123
    df = spark.createDataFrame([("u", nanos), ("u", nanos + 10**9)], "user_id string, recorded_at long")
    out = gl.sessionize(df)
    assert rows(out, "recorded_at", "round_index") == [(T0, 1), (at(seconds=1), 1)]
    days = spark.sql("select 'u' as user_id, date'2024-03-01' as recorded_at")
    assert gl.sessionize(days).first().round_start == datetime(2024, 3, 1)
    with pytest.raises(TypeError):
        gl.sessionize(spark.sql("select 'u' as user_id, true as recorded_at"))


def test_mixed_offsets_are_one_instant(spark):
    data = [("u", "2024-03-01T09:00:00Z"), ("u", "2024-03-01T11:00:00+02:00")]
    df = spark.createDataFrame(data, "user_id string, recorded_at string")
    assert gl.sessionize(df, gap_minutes=0).select("round_id").distinct().count() == 1


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz"])
def test_clock_changes_do_not_count(spark, dtype):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        times = {
            # One hour apart as instants, two on the wall clock.
            "timestamp": ["2024-03-10 06:30:00Z", "2024-03-10 07:30:00Z"],
            # Zone-free times, the second of which this zone skips.
            "timestamp_ntz": ["2024-03-10 01:30:00", "2024-03-10 02:30:00"],
        }[dtype]
        df = spark.createDataFrame([("u", t) for t in times], "user_id string, t string")
        df = df.select("user_id", F.col("t").cast(dtype).alias("recorded_at"))
        joined = gl.sessionize(df, gap_minutes=60)
        assert {r.round_id for r in joined.select("round_id").collect()} == {"u_1"}
        features = gl.compute_round_features(joined).first()
        assert features.duration_seconds == 3600.0
        assert gl.sessionize(df, gap_minutes=59.99).select("round_id").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_other_columns_pass_through_whatever_their_name(spark):
    data = [("u", T0, 1, {"k": 1}), ("u", at(minutes=5), 2, {"k": 2})]
    df = spark.createDataFrame(data, "user string, at timestamp, cell int, n map<string,int>")
    out = gl.sessionize(df, "user", "at")
    assert out.columns[:4] == ["user", "at", "cell", "n"]
    assert rows(out, "cell", "n", "round_id", order=["at"]) == [
        (1, {"k": 1}, "u_1"), (2, {"k": 2}, "u_1"),
    ]


def test_integer_users(spark):
    df = spark.createDataFrame([(7, T0)], "user_id bigint, recorded_at timestamp")
    assert gl.sessionize(df).first().round_id == "7_1"


def test_underscores_do_not_mix_users(spark):
    data = [("a", T0, "x"), ("a_1", T0, "x")]
    out = gl.sessionize(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.round_id for r in out.collect()) == ["a_1", "a_1_1"]


def test_bad_arguments(spark):
    df = spark.createDataFrame([("u", T0, "a")], SCHEMA)
    with pytest.raises(ValueError, match="collide"):
        gl.sessionize(gl.sessionize(df))
    with pytest.raises(ValueError, match="missing columns"):
        gl.sessionize(df, ts_col="ts")
    with pytest.raises(ValueError, match="negative"):
        gl.sessionize(df, gap_minutes=-1)


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert gl.sessionize(empty).count() == 0
    assert gl.round_features(empty).count() == 0


EVENTS = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.one_of(
            st.none(),
            # Around whole minutes, where the boundary and the cells are.
            st.builds(
                lambda m, us: at(minutes=m, microseconds=us),
                st.integers(-400, 400),
                st.integers(-2, 2),
            ),
        ),
        st.sampled_from(["x", "y", None]),
    ),
    min_size=1,
    max_size=40,
)


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=list(HealthCheck),
    phases=[Phase.explicit, Phase.generate],  # each example is a Spark run: do not shrink
)
@given(data=EVENTS, gap=st.sampled_from(GAPS))
def test_against_brute_force(spark, data, gap):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = brute.rounds(data, gap)
    fused = gl.round_features(df, gap_minutes=gap)
    assert [r.asDict() for r in fused.orderBy("round_id").collect()] == want

    staged = gl.round_features(df, gap_minutes=gap, single_scan=True)
    assert [r.asDict() for r in staged.orderBy("round_id").collect()] == want

    events = gl.sessionize(df, gap_minutes=gap)
    two_step = gl.compute_round_features(events, gap_minutes=gap)
    assert [r.asDict() for r in two_step.orderBy("round_id").collect()] == want

    # Every event carries the bounds and size of its round.
    bounds = {(r["round_id"], r["round_start"], r["round_end"], r["event_count"]) for r in want}
    got = events.select("round_id", "round_start", "round_end", "event_count").collect()
    assert {tuple(r) for r in got} == bounds
    assert len(got) == sum(user is not None for user, _, _ in data)
    if gap and any(u is not None and t is not None for u, t, _ in data):
        windows = gl.session_rounds(df, gap_minutes=gap).collect()
        assert sorted(tuple(r)[1:] for r in windows) == sorted(
            (r["round_start"], r["round_end"], r["event_count"]) for r in want if r["round_start"]
        )


def test_larger_gaps_never_give_more_rounds(events):
    counts = [
        gl.round_features(events, ts_col="ts", gap_minutes=g, labels=[]).count()
        for g in [0.5, 5, 30, 240, 1440]
    ]
    assert counts == sorted(counts, reverse=True)
    assert counts[1:] == [9919, 9549, 6940, 1214]
