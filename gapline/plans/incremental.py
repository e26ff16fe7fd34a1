"""A feature table that grows with its log, batch by batch.

Each batch of events costs what it holds, not what came before. Of the past it needs one
row per user: the *tail*, the user's last round, which may still grow, with its number and the end
of the round before it. A batch's cells and the tails of its users make new rounds; all but a
user's last one are final, and the last one is the new tail.

Cells that lie so far back that they may change a round that is final are *late*. They are not
dropped but kept in a ledger, and ``repair`` makes the rounds of their users anew. After it the
table is what one job over the whole log makes.

The store is a folder of Parquet tables, to which batches add files; no file is ever changed, so
readers are not disturbed. What a batch writes is named after its number, and counts from the moment
its tails are complete: a batch that is run again, as streams do after a failure, replaces itself.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gapline.functions.time import epoch_micros, gap_micros, parse_time
from gapline.operators.cells import CellSpec, number_rounds
from gapline.operators.features import finish_features, label_counts
from gapline.operators.sessionize import round_id
from gapline.schema import DEFAULT_GAP_MINUTES, FEATURE_COLUMNS, LABEL, TIME, USER, col, reject_names, require_columns
from gapline.sources.recordings import recordings_stream
from gapline.sources.scratch import children, cleared, exists, written

#: Batches after which the tails of all users are written together.
SNAPSHOT_EVERY = 16


@dataclass(frozen=True)
class StoreSettings:
    """What all batches of a store must agree on. ``user_type`` and ``time_type`` are Spark type names."""

    user_col: str
    ts_col: str
    gap: int
    labels: tuple[str, ...]
    user_type: str
    time_type: str


@dataclass(frozen=True)
class BatchReport:
    """Events of a batch: those in rounds, those in the ledger, those without a user or a time."""

    events: int
    late: int
    no_user: int
    no_time: int


class RoundStore:
    """A feature table in a folder that all executors share. See :func:`open_store`."""

    def __init__(self, spark: SparkSession, path: str, settings: StoreSettings) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.spec = CellSpec(settings.user_col, "first_ts", settings.gap)
        # Internal names, so that labels cannot meet the columns of rounds.
        self.counts = [f"label_{k}" for k in range(len(settings.labels))]
        user, time = (f.dataType for f in T.StructType.fromDDL(f"u {settings.user_type}, t {settings.time_type}"))
        number = T.LongType()
        columns = [
            ("user", user), ("round_index", number), ("round_start", time), ("round_end", time),
            ("event_count", number), ("prev_round_end", time), *((c, number) for c in self.counts),
        ]
        self.schema = T.StructType([T.StructField(n, t) for n, t in columns])

    # --- what is there

    def _entries(self, table: str) -> list[int]:
        """Numbers of a table's complete parts."""
        found = children(self.spark, f"{self.path}/{table}")
        parts = [name for name in found if name.startswith("part=") and exists(self.spark, f"{self.path}/{table}/{name}/_SUCCESS")]
        return sorted(int(name.removeprefix("part=")) for name in parts)

    def _read(self, table: str, parts: list[int]) -> DataFrame:
        """Rows of some parts, with the column ``part``."""
        schema = T.StructType([*self.schema.fields, T.StructField("part", T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{table}/part={p}" for p in parts]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _write(self, rows: DataFrame, table: str, part: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{table}/part={part}")

    # Tails of batch n are part 2n, and those that a repair after it has changed are part 2n + 1.
    def batches(self) -> list[int]:
        """Numbers of the batches that are in."""
        return [p // 2 for p in self._entries("tails") if p % 2 == 0]

    def _repairs(self) -> list[int]:
        return [p // 2 for p in self._entries("tails") if p % 2]

    def tails(self, before: int | None = None) -> DataFrame:
        """Each user's last round. ``before``: as it was before that batch."""
        limit = float("inf") if before is None else 2 * before
        full = max((p for p in self._entries("snapshots") if p < limit), default=-1)
        parts = [p for p in self._entries("tails") if full < p < limit]
        rows = self._read("snapshots", [full] if full >= 0 else []).unionByName(self._read("tails", parts))
        newest = F.max_by(F.struct(*self.schema.names), "part").alias("tail")
        return rows.groupBy("user").agg(newest).select("tail.*")

    def ledger(self) -> DataFrame:
        """Late cells: user, first and last time (as ``round_start`` and ``round_end``), events, labels; ``part``
        is the batch they came with. Those up to the last repair are in the rounds."""
        return self._read("late", [p for p in self._entries("late") if p in set(self.batches())])

    def _finals(self) -> DataFrame:
        """All rounds but the tails: the last repair of a user, and what came after it."""
        repairs = self._repairs()
        rounds = self._read("rounds", self.batches())
        if not repairs:
            return rounds.drop("part")
        repaired = self._read("repairs", repairs)
        # A user with late rows can have no final round left, so the tails of a repair say who was in it.
        last = self._read("tails", [2 * p + 1 for p in repairs]).groupBy("user").agg(F.max(F.floor(F.col("part") / 2)).alias("repair"))
        since = rounds.join(last, "user", "left").where("repair is null or part > repair")
        newest = repaired.join(last, "user").where("part = repair")
        return since.unionByName(newest).select(*self.schema.names)

    def rounds(self, closed_before: Column | None = None) -> DataFrame:
        """The feature table (see :func:`gapline.round_features`) of all events but late ones that are not repaired.

        ``closed_before``: only rounds that ended a gap or more before that time. Others may still grow.
        """
        s = self.settings
        found = self._finals().unionByName(self.tails())
        if closed_before is not None:
            end = epoch_micros(found, "round_end") + s.gap
            found = found.where(end <= epoch_micros(found, closed_before, "round_end"))
        found = found.withColumn("round_id", round_id(F.col("user"), F.col("round_index"))).drop("round_index")
        found = found.withColumnsRenamed({"user": s.user_col} | dict(zip(self.counts, s.labels, strict=True)))
        return finish_features(found, s.user_col, "round_id", list(s.labels))

    # --- batches

    def cells(self, events: DataFrame) -> DataFrame:
        """A row per user and cell, with the columns of a round."""
        s = self.settings
        spec = CellSpec(s.user_col, s.ts_col, s.gap)
        ts = col(s.ts_col)
        return (
            events.groupBy(col(s.user_col).alias("user"), spec.cell(events).alias("cell"))
            .agg(
                F.min(ts).alias("round_start"), F.max(ts).alias("round_end"), F.count("*").alias("event_count"),
                *(c.alias(n) for n, c in zip(self.counts, label_counts(events, list(s.labels)) if s.labels else [], strict=True)),
            )
            .select("user", F.lit(1).cast("long").alias("round_index"), "round_start", "round_end", "event_count", F.lit(None).cast(s.time_type).alias("prev_round_end"), *self.counts)
        )

    def merged(self, rows: DataFrame) -> DataFrame:
        """Rounds from cells and rounds of whole users, numbered from the smallest ``round_index`` on, with ``is_last``.

        The earliest ``prev_round_end`` belongs to the first of the user's rounds.
        """
        base, prev = Window.partitionBy("user"), F.col("prev_round_end")
        cells = rows.select(
            "user", epoch_micros(rows, "round_start").alias("cell"), F.col("round_start").alias("first_ts"), F.col("round_end").alias("last_ts"),
            F.col("event_count").alias("n"), "round_index", "prev_round_end", *self.counts,
        ).withColumnsRenamed({"round_index": "old_index", "prev_round_end": "old_prev"})
        rounds = (
            number_rounds(cells, self.spec)
            .groupBy("user", "round_index")
            .agg(
                F.min("first_ts").alias("round_start"), F.max("last_ts").alias("round_end"), F.sum("n").alias("event_count"),
                F.max(F.when(F.col("opens"), F.col("prev_ts"))).alias("prev_round_end"),
                F.max("old_index").alias("old_index"), F.min("old_prev").alias("old_prev"), *(F.sum(c).alias(c) for c in self.counts),
            )
        )
        place = F.col("round_index")
        return rounds.select(
            "user", (place + F.max("old_index").over(base) - 1).alias("round_index"), "round_start", "round_end", "event_count",
            F.when(place == 1, F.min("old_prev").over(base)).otherwise(prev).alias("prev_round_end"), *self.counts,
            (place == F.max(place).over(base)).alias("is_last"),
        )

    def split_late(self, cells: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cells that can only change their user's tail or what comes after it, and late ones."""
        before = tails.select("user", F.col("prev_round_end").alias("final_end"))
        joined = cells.join(before, "user", "left")
        distance = epoch_micros(joined, "round_start") - epoch_micros(joined, "final_end")
        late = F.coalesce(distance <= self.settings.gap, F.lit(False))
        names = self.schema.names
        return joined.where(~late).select(*names), joined.where(late).select(*names)

    def add(self, events: DataFrame, batch: int) -> BatchReport:
        """Take a batch of events in. Batches go in ascending order; the newest may be run again."""
        s = self.settings
        done = self.batches()
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}: the stream's checkpoint does not belong to this store")
        if batch in self._repairs():
            raise ValueError(f"batch {batch} was repaired already and cannot be run again")
        require_columns(events, s.user_col, s.ts_col, *([LABEL] if s.labels else []))
        typed = events.withColumn(s.user_col, col(s.user_col).cast(s.user_type))
        timed = parse_time(typed, s.ts_col, strict=False)
        timed = timed.withColumn(s.ts_col, _as_type(timed, s.ts_col, s.time_type))
        no_user, no_time = F.col("user").isNull(), F.col("round_start").isNull()
        with cleared(self.spark):
            # Rows without a user or a time are counted on the way, in cells of their own.
            every = written(self.cells(timed), "cells")
            cells = every.where(~no_user & ~no_time)
            tails = self.tails(batch)
            on_time, late = self.split_late(cells, tails)
            self._write(late, "late", batch)
            touched = tails.join(on_time.select("user").distinct(), "user", "left_semi")
            rounds = written(self.merged(on_time.unionByName(touched)), "rounds")
            self._finish(rounds, "rounds", batch, 2 * batch)
            rows = F.col("event_count")
            counted = every.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (rows, F.when(no_user, rows), F.when(~no_user & no_time, rows)))).first()
        dropped = self._read("late", [batch]).agg(F.coalesce(F.sum("event_count"), F.lit(0))).first()[0]
        return BatchReport(counted[0] - dropped - counted[1] - counted[2], dropped, counted[1], counted[2])

    def _finish(self, rounds: DataFrame, table: str, batch: int, part: int) -> None:
        """Write final rounds and, last, the tails, from which on they count."""
        self._write(rounds.where("not is_last"), table, batch)
        self._write(rounds.where("is_last"), "tails", part)
        full = max(self._entries("snapshots"), default=-1)
        if sum(p > full for p in self._entries("tails")) >= SNAPSHOT_EVERY:
            self._write(self.tails(), "snapshots", part)

    def repair(self) -> int:
        """Make the rounds of users with late events anew; returns the number of late events taken in.

        Only rounds of these users are read, as rounds: their events are not needed. To be run while no
        batch is. Without late events it does nothing.
        """
        batches, repaired = self.batches(), max(self._repairs(), default=-1)
        pending = [p for p in self._entries("late") if repaired < p and p in set(batches)]
        late = self._read("late", pending).drop("part")
        taken = late.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("n")).first()["n"]
        if not taken:
            return 0
        with cleared(self.spark):
            users = written(late.select("user").distinct(), "late-users")
            known = self._finals().unionByName(self.tails()).join(users, "user", "left_semi")
            # From the first round on: all numbers and distances are made anew.
            whole = known.unionByName(late).withColumns({"round_index": F.lit(1).cast("long"), "prev_round_end": F.lit(None).cast(self.settings.time_type)})
            self._finish(written(self.merged(whole), "rounds"), "repairs", batches[-1], 2 * batches[-1] + 1)
        return taken

    def stream(
        self,
        source: str,
        schema: T.StructType | str,
        checkpoint: str,
        fmt: str = "parquet",
        options: dict[str, str] | None = None,
        poll: str | None = None,
    ) -> StreamingQuery:
        """Start a query that takes arriving files in, a micro-batch at a time (see :func:`gapline.stream_rounds`).

        ``checkpoint`` must be this store's own: batch numbers are the stream's.
        """
        events = recordings_stream(self.spark, source, schema, fmt, options)

        def take(batch: DataFrame, number: int) -> None:
            # A micro-batch has a session of its own.
            RoundStore(batch.sparkSession, self.path, self.settings).add(batch, number)

        writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def _as_type(df: DataFrame, ts_col: str, time_type: str) -> Column:
    """The time as the store's type. Times without a zone are UTC instants, whatever the session's zone."""
    if df.schema[ts_col].dataType.simpleString() == time_type:
        return col(ts_col)
    return F.timestamp_micros(epoch_micros(df, ts_col))


def open_store(
    spark: SparkSession,
    path: str,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    labels: list[str] | None = None,
    user_type: str = "string",
) -> RoundStore:
    """The store at ``path``, made if there is none. ``labels`` get a counting column each.

    A store that is there must have been made with the same settings. Times are kept as instants
    (``timestamp``); times without a zone are taken as UTC. ``user_type`` is the type users are kept as.
    """
    labels = list(labels or [])
    reject_names(labels, [user_col, *FEATURE_COLUMNS], "labels")
    settings = StoreSettings(user_col, ts_col, gap_micros(gap_minutes), tuple(labels), user_type, "timestamp")
    line = json.dumps(asdict(settings))
    about = f"{path.rstrip('/')}/settings"
    if exists(spark, f"{about}/_SUCCESS"):
        found = spark.read.text(about, wholetext=True).first()[0].strip()
        if found != line:
            raise ValueError(f"the store at {path} was made with {found}, not with {line}")
    else:
        spark.createDataFrame([(line,)], "line string").coalesce(1).write.mode("overwrite").text(about)
    return RoundStore(spark, path, settings)
