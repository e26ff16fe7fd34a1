import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import gapline as gl
from gapline.streaming.rounds import closed_rounds

T0 = datetime(2024, 1, 1, 9)
SCHEMA = "user_id string, recorded_at timestamp, event_type string"


class Stream:
    """A watched folder and what the stream makes of it."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.source = folder / "in"
        self.source.mkdir()
        self.batches = 0

    def add(self, rows, schema=SCHEMA):
        part = self.folder / f"part-{self.batches}"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        for file in part.glob("*.parquet"):
            shutil.copy(file, self.source / f"{self.batches}-{file.name}")
        self.batches += 1

    def run(self):
        query = gl.stream_rounds(
            self.spark, str(self.source), SCHEMA, str(self.folder / "out"),
            str(self.folder / "state"), labels=["a", "b"], **self.options,
        )
        query.awaitTermination()
        self.progress = query.recentProgress
        return self.closed()

    def closed(self):
        df = self.spark.read.parquet(str(self.folder / "out"))
        return sorted(tuple(r) for r in df.select("user_id", "round_start", "event_count", "a").collect())


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_rounds_close_once(spark, tmp_path):
    stream = Stream(spark, tmp_path, gap_minutes=30, delay_minutes=10)
    stream.add([("u", at(0), "a"), ("u", at(5), "b"), ("v", at(60), "a"), (None, at(1), "a"), ("u", None, "a")])
    assert stream.run() == [("u", at(0), 2, 1)]  # v may still grow
    rejects = [p.observedMetrics["rejects"] for p in stream.progress if "rejects" in p.observedMetrics]
    assert sum(r.null_user for r in rejects) == sum(r.no_time for r in rejects) == 1
    assert stream.run() == [("u", at(0), 2, 1)]
    stream.add([("v", at(70), "a"), ("u", at(200), "b")])
    assert stream.run() == [("u", at(0), 2, 1), ("v", at(60), 2, 2)]


def test_late_events_are_left_to_the_batch_job(spark, tmp_path):
    stream = Stream(spark, tmp_path, gap_minutes=30, delay_minutes=10)
    stream.add([("u", at(0), "a"), ("v", at(300), "a")])
    stream.run()
    stream.add([("u", at(1), "a"), ("v", at(500), "a")])
    assert stream.run() == [("u", at(0), 1, 1), ("v", at(300), 1, 1)]
    log = spark.read.schema(SCHEMA).parquet(str(stream.source))
    assert gl.round_features(log).where("user_id = 'u'").first().event_count == 2


def test_split_rounds_are_merged_again(spark):
    closed = spark.createDataFrame(
        [("u", at(0), at(20), 2, 1), ("u", at(45), at(50), 1, 1), ("u", at(200), at(200), 1, 0)],
        "user_id string, round_start timestamp, round_end timestamp, event_count bigint, a bigint",
    )
    got = gl.index_closed_rounds(closed, labels=["a"]).orderBy("round_id").collect()
    assert [(r.round_id, r.event_count, r.a, r.duration_seconds) for r in got] == [
        ("u_1", 3, 2, 3000.0), ("u_2", 1, 0, 0.0),
    ]
    assert got[1].gap_since_prev_seconds == 150 * 60.0


@pytest.mark.parametrize("gap", [0.5, 240])
def test_stream_in_two_parts_equals_batch(spark, events, tmp_path, gap):
    source = tmp_path / "in"
    cut = "ts < timestamp_ntz'2024-01-15'"
    def run():
        gl.stream_rounds(
            spark, str(source), "user_id bigint, ts timestamp_ntz, event_type string",
            str(tmp_path / "out"), str(tmp_path / "state"), ts_col="ts", gap_minutes=gap,
            options={"recursiveFileLookup": "true"}, labels=["click"],
        ).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))
    narrow = events.select("user_id", "ts", "event_type")
    narrow.where(cut).write.parquet(str(source / "1"))
    first = run().count()
    narrow.where(f"not ({cut})").write.parquet(str(source / "2"))
    closed = run()
    assert 0 < first < closed.count()
    got = gl.index_closed_rounds(closed, gap_minutes=gap, labels=["click"])
    times = ["round_start", "round_end", "prev_round_end"]
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})
    batch = gl.round_features(events, ts_col="ts", gap_minutes=gap, labels=["click"])
    last = events.agg(F.max("ts")).first()[0]
    want = batch.where(F.col("round_end") <= F.lit(last - timedelta(minutes=gap + 10)))
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty()


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = "u,2024-01-01T09:00:00Z\nu,broken\nv,2024-01-01T12:00:00Z\n"
    (tmp_path / "in" / "a.csv").write_text("user_id,recorded_at\n" + rows)
    gl.stream_rounds(
        spark, str(tmp_path / "in"), "user_id string, recorded_at string", str(tmp_path / "out"),
        str(tmp_path / "state"), fmt="csv",
    ).awaitTermination()
    assert [r.user_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["u"]


def test_polling_query_keeps_running(spark, tmp_path):
    (tmp_path / "in").mkdir()
    query = gl.stream_rounds(
        spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "state"),
        poll="60 seconds",
    )
    try:
        assert query.isActive
    finally:
        query.stop()


def test_needs_a_gap(spark):
    with pytest.raises(ValueError, match="positive"):
        closed_rounds(spark.createDataFrame([], SCHEMA), gap_minutes=0)
