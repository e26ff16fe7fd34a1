"""What the physical plans look like, and that hot keys do not hurt them."""

import contextlib
import io
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import gapline as gl
from gapline.functions.time import MICROS
from gapline.operators.cells import CellSpec, build_cells

LABELS = ["click", "error", "purchase", "signup", "view"]


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def exchanges(df):
    return re.findall(r"Exchange (\w+(?:\([^)]*\))?)", plan(df))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def features(events, gap=240, **options):
    options = {"labels": LABELS, "missing_times": False} | options
    return gl.round_features(events, ts_col="ts", gap_minutes=gap, **options)


def test_features_shuffle_cells_only(events):
    df = features(events)
    text = plan(df)
    assert len(exchanges(df)) == 2
    # Events are aggregated before they are first shuffled.
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "partial_count" in below and "Window" not in below
    # What is shuffled is as wide for five event types as for fifty.
    assert "hashpartitioning(user_id" in below
    assert text.count("FileScan") == 1
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>", text)
    assert "Join" not in text and "Python" not in text


def test_unused_columns_are_not_read(events):
    text = plan(features(events))
    assert "props" not in text and "value" not in text
    assert "event_type" not in plan(features(events, labels=[]))


def test_user_filter_reaches_the_scan(events):
    text = plan(features(events).where("user_id = 5"))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(user_id,5\)", text)


def test_no_single_partition_over_data(events, spark):
    for df in (
        features(events),
        features(events, gap=0.5),
        features(events, missing_times=True),
        gl.sessionize(events, ts_col="ts", missing_times=False),
        gl.latest_rounds(features(events)),
        gl.with_global_rank(features(events), ["round_start", "round_id"])[0],
    ):
        text = plan(df)
        assert "SinglePartition" not in text
        assert "Python" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text


def test_event_join_is_shuffled_by_cell(events, no_broadcast):
    df = gl.sessionize(events, ts_col="ts", missing_times=False)
    keys = [e for e in exchanges(df) if "_event_cell" in e]
    assert len(keys) == 1 and "user_id" in keys[0]
    text = plan(df)
    # The branch that finds the rounds reads two columns.
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_latest_keeps_one_row_per_user_before_the_shuffle(spark, events, tmp_path):
    path = str(tmp_path / "f")
    features(events).write.parquet(path)
    text = plan(gl.latest_rounds(spark.read.parquet(path)))
    below = text[text.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below


def test_short_gaps_are_numbered_by_chunk(events):
    assert any("chunk" in e for e in exchanges(features(events, gap=0.5)))
    assert not any("chunk" in e for e in exchanges(features(events, gap=1)))


def hot(spark, rows=200_000):
    """A third of all events belong to one user, and a third of those to one instant."""
    t0 = datetime(2024, 1, 1)
    n = F.col("id")
    user = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), n % 997))
    micros = F.when(n % 9 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(30 * 86_400 * MICROS)))
    base = int(t0.timestamp()) * MICROS
    return spark.range(rows, numPartitions=8).select(
        user.alias("user_id"),
        F.timestamp_micros(F.lit(base) + micros).alias("ts"),
        F.when(n % 2 == 0, "click").otherwise("view").alias("event_type"),
    )


@pytest.mark.parametrize("gap", [0.5, 240])
def test_hot_user_shrinks_before_the_shuffle(spark, gap):
    df = hot(spark)
    spec = CellSpec("user_id", "ts", int(gap * 60 * MICROS))
    cells = build_cells(df, spec).where("user = 'hot'")
    n, most = cells.agg(F.count("*"), F.sum("n")).first()
    assert most == df.where("user_id = 'hot'").count()
    # The clock bounds what is left, here 30 days of cells.
    assert n <= 30 * 24 * 60 / gap + 2
    assert cells.agg(F.max("n")).first()[0] >= 200_000 // 9


@pytest.mark.parametrize("gap", [0.05, 240])
def test_hot_user_gets_the_right_rounds(spark, gap):
    df = hot(spark, 60_000)
    got = gl.round_features(df, ts_col="ts", gap_minutes=gap, labels=LABELS[:1])
    df.createOrReplaceTempView("hot_events")
    micros = int(gap * 60 * MICROS)
    want = spark.sql(
        f"""
        with lagged as (select *, unix_micros(ts) - unix_micros(lag(ts) over (partition by user_id order by ts)) as d
                        from hot_events),
             marked as (select *, sum(case when d is null or d > {micros} then 1 else 0 end) over (
                        partition by user_id order by ts range unbounded preceding) as k from lagged)
        select concat(user_id, '_', k) as round_id, user_id, min(ts) as round_start, max(ts) as round_end,
               count(*) as event_count, count_if(event_type = 'click') as click
        from marked group by user_id, k"""
    )
    assert got.select(want.columns).exceptAll(want).isEmpty()
    assert got.count() == want.count()


def test_hot_cell_of_the_event_join_is_split(spark, no_broadcast):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        even = F.col("id") % 2 == 0
        events = spark.range(100_000, numPartitions=8).select(
            F.when(even, 0).otherwise(F.col("id")).alias("user_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.when(even, 0).otherwise(F.col("id"))).alias("ts"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        df = gl.sessionize(events, ts_col="ts", missing_times=False)
        assert sorted(r.event_count for r in df.collect())[-50_000:] == [50_000] * 50_000
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_untimed_events_of_one_user(spark, monkeypatch):
    monkeypatch.setattr("gapline.operators.features._BLOCK", 100)
    t0 = datetime(2024, 1, 1)
    n = F.col("id")
    df = spark.range(2000).select(
        F.lit("u").alias("user_id"),
        F.when(n < 10, F.lit(t0) + F.make_dt_interval(hours=n.cast("int"))).cast("timestamp").alias("ts"),
        F.when(n % 2 == 0, "a").when(n % 3 == 0, "b").alias("event_type"),
    )
    got = gl.round_features(df, ts_col="ts", gap_minutes=30)
    two_step = gl.compute_round_features(gl.sessionize(df, ts_col="ts", gap_minutes=30), ts_col="ts")
    assert got.count() == 10 + 1989
    assert got.exceptAll(two_step).isEmpty()
    assert got.agg(F.sum("a"), F.sum("b")).first() == df.agg(
        F.count_if(F.col("event_type") == "a"), F.count_if(F.col("event_type") == "b")
    ).first()


def test_rank_splits_equal_leading_keys(spark):
    df = spark.range(20_000).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        ranked, _ = gl.with_global_rank(df, ["a", "b"])
    finally:
        spark.conf.set(conf, before)
    assert ranked.where("rn <> b").isEmpty()
    sizes = [r[0] for r in ranked.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) > 4 and max(sizes) < 10_000


def test_streamed_state_merges_on_the_mapper(spark):
    conf = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    assert spark.conf.get(conf) == "false"  # set for the query only


def test_elapsed_time_is_exact(spark):
    a, b = datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1)
    df = spark.createDataFrame([(a, b)], "a timestamp, b timestamp")
    assert df.select(gl.elapsed_seconds(df, "b", "a")).first()[0] == (b - a) / timedelta(seconds=1)
