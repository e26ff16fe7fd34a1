"""One feature row per round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.time import MICROS, elapsed_seconds, epoch_micros, gap_micros, parse_time
from gapline.operators.cells import SINGLE_TASK_GAP_MICROS, CellSpec, build_cells, number_rounds
from gapline.operators.sessionize import round_id
from gapline.schema import (
    DEFAULT_GAP_MINUTES,
    FEATURE_COLUMNS,
    LABEL,
    ROUND_COLUMNS,
    TIME,
    USER,
    col,
    reject_names,
    require_columns,
)
from gapline.sources.scratch import written

_BLOCK = 100_000
#: From so many event types on the counts of a cell are packed into one row before users are gathered.
PACKED_FROM = 17


def event_type_labels(df: DataFrame, label_col: str = LABEL) -> list[str]:
    """Distinct non-null labels in sorted order.

    They become columns, so their number is held to ``spark.sql.pivotMaxValues``,
    as in Spark's own pivot; more is an error. :func:`label_maps` takes any number.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    label = col(label_col).cast("string").alias("label")
    rows = df.select(label).where("label is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{label_col} has more than {most} distinct values")
    return sorted(r.label for r in rows)


def label_counts(
    df: DataFrame, labels: list[str], label_col: str = LABEL, prefix: str = ""
) -> list[Column]:
    """One counting aggregate per label, in the given order."""
    label = col(label_col).cast("string")
    return [F.count_if(label == F.lit(v)).alias(prefix + v) for v in labels]


def _resolve_labels(df: DataFrame, labels: list[str] | None, user_col: str, prefix: str) -> list[str]:
    if LABEL not in df.columns:
        return []
    found = event_type_labels(df) if labels is None else list(labels)
    reject_names([prefix + v for v in found], [user_col, *FEATURE_COLUMNS], "labels")
    return found


def compute_round_features(
    sessionized: DataFrame,
    user_col: str = USER,
    round_id_col: str = "round_id",
    ts_col: str = TIME,
    labels: list[str] | None = None,
    prefix: str = "",
    gap_minutes: float | None = None,
) -> DataFrame:
    """Feature rows from a sessionized event log.

    Columns: round id, user, ``round_start, round_end, event_count,
    duration_seconds``, one count per event type (if there is an ``event_type``
    column), ``prev_round_end, gap_since_prev_seconds`` (-1 on a user's first
    round). ``labels=None`` runs one job to find the event types; give them to
    stay lazy. ``prefix`` is put before label columns.

    ``gap_minutes`` does not change the result. It says how close rounds of one
    user can lie, and so how many there can be: from a minute up they are few
    enough to be ordered per user directly, below and for ``None`` they are ordered per hour first.

    Rounds without any time have no place in time: their ``prev_round_end`` is
    null and their gap -1. To go from raw events to features use
    :func:`round_features`, which never shuffles events.
    """
    require_columns(sessionized, user_col, round_id_col, ts_col)
    labels = _resolve_labels(sessionized, labels, user_col, prefix)
    ts = col(ts_col)
    rounds = sessionized.groupBy(col(round_id_col), col(user_col)).agg(
        F.min(ts).alias("round_start"),
        F.max(ts).alias("round_end"),
        F.count(ts).alias("event_count"),
        *label_counts(sessionized, labels, prefix=prefix),
    )
    gap = 0 if gap_minutes is None else gap_micros(gap_minutes)
    rounds = _with_prev_end(rounds, user_col, round_id_col, gap)
    return finish_features(rounds, user_col, round_id_col, [prefix + v for v in labels])


def round_features(
    df: DataFrame,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    labels: list[str] | None = None,
    prefix: str = "",
    missing_times: bool | None = None,
    single_scan: bool = False,
) -> DataFrame:
    """Feature rows straight from raw events.

    The same rows as ``compute_round_features(sessionize(df))``, but only
    pre-aggregated cells are shuffled, never events.

    What is not given of ``labels`` and ``missing_times`` (see
    :func:`gapline.sessionize`) is looked up first, which is cheap on Parquet.
    Where reading the input again is not, as with CSV, ``single_scan`` reads it
    once, writes cells per event type to the shared folder, and takes everything
    from there.
    """
    require_columns(df, user_col, ts_col)
    reject_names(ROUND_COLUMNS, df.columns, "input columns")
    spec = CellSpec(user_col, ts_col, gap_micros(gap_minutes))
    events = parse_time(df, ts_col).where(col(user_col).isNotNull())
    untimed = col(ts_col).isNull()
    text = col(LABEL).cast("string") if LABEL in df.columns else None
    if single_scan:
        staged = written(build_cells(events, spec, text), "cells")
        events, untimed, text = staged.withColumnRenamed("label", LABEL), F.col("cell").isNull(), F.col(LABEL)
    labels = _resolve_labels(events, labels, user_col, prefix)
    if missing_times is None:
        missing_times = not events.where(untimed).isEmpty()
    if not missing_times:
        events = events.where(~untimed)

    # Cells carry the label's place in the list, 0 for none or one not listed.
    code = F.coalesce(F.array_position(F.lit(labels), text), F.lit(0)) if labels else None
    if not single_scan:
        cells = build_cells(events, spec, code)
    else:
        cells = events.withColumn("label", F.lit(0) if code is None else code)
    if len(labels) >= PACKED_FROM:
        cells = packed_cells(cells, spec)
        counts = {prefix + v: F.coalesce(F.try_element_at("counts", F.lit(i)), F.lit(0)) for i, v in enumerate(labels, 1)}
    else:
        counts = {
            prefix + v: F.when(F.col("label") == F.lit(i), F.col("n")).otherwise(F.lit(0))
            for i, v in enumerate(labels, 1)
        }
    return features_from_cells(cells, spec, counts, missing_times)


def features_from_cells(
    cells: DataFrame, spec: CellSpec, counts: dict[str, Column], untimed: bool = False
) -> DataFrame:
    """Number the cells' rounds and add up each round's cells.

    ``counts`` gives, per label column of the result, a cell row's share in it.
    ``untimed`` says whether there may be rows without a time.
    """
    # Internal names, so that labels cannot meet the columns of the cells.
    names = {f"label_{i}": v for i, v in enumerate(counts)}
    shares = dict(zip(names, counts.values()))
    timed = F.col("first_ts").isNotNull()

    def total(value: Column, where: Column | None = None) -> Column:
        return F.sum(value if where is None else F.when(where, value).otherwise(F.lit(0)))

    only = timed if untimed else None
    sums = [total(F.col("n"), only).alias("event_count")]
    sums += [total(share, only).alias(n) for n, share in shares.items()]
    if untimed:
        sums.append(total(F.col("n"), ~timed).alias("untimed"))
        sums += [total(share, ~timed).alias(f"loose_{n}") for n, share in shares.items()]
    rounds = (
        number_rounds(cells, spec)
        .groupBy("user", "round_index")
        .agg(
            F.min("first_ts").alias("round_start"),
            F.max("last_ts").alias("round_end"),
            F.max(F.when(F.col("opens"), F.col("prev_ts"))).alias("prev_round_end"),
            *sums,
        )
    )
    if untimed:
        rounds = _unfold_untimed(rounds, list(names))
    rounds = rounds.withColumn("round_id", round_id(F.col("user"), F.col("round_index"))).drop("round_index")
    rounds = rounds.withColumnsRenamed({"user": spec.user_col} | names)
    return finish_features(rounds, spec.user_col, "round_id", list(counts))


def packed_cells(cells: DataFrame, spec: CellSpec) -> DataFrame:
    """One row per cell from rows split by ``label``: ``counts`` maps labels (not null) to their events.

    The rows are brought to their user, where the next step wants them; below a minute's gap, where one
    user can have very many, to their cell.
    """
    gathered = cells.repartition("user") if spec.single_task else cells
    entries = F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))
    return gathered.groupBy("user", "cell").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        F.map_from_entries(entries).alias("counts"),
    )


def label_maps(
    df: DataFrame,
    user_col: str = USER,
    ts_col: str = TIME,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    label_col: str = LABEL,
) -> DataFrame:
    """``round_id``, user and ``label_counts``, a map from each event type of the round to its events.

    The sparse form of the counts per event type: for any number of types, found in the one scan that
    finds the rounds. Null types have no entry, and rounds with no other have an empty map. Events without
    a user or a time are left out; the rounds and their numbers are those of :func:`round_features`
    without events that have no time.
    """
    require_columns(df, user_col, ts_col, label_col)
    spec = CellSpec(user_col, ts_col, gap_micros(gap_minutes))
    events = parse_time(df, ts_col)
    events = events.where(col(user_col).isNotNull() & col(ts_col).isNotNull())
    cells = packed_cells(build_cells(events, spec, col(label_col).cast("string")), spec)
    entry = F.explode_outer(F.map_entries("counts")).alias("entry")
    sums = (
        number_rounds(cells, spec)
        .select("user", "round_index", entry)
        .groupBy("user", "round_index", F.col("entry.key").alias("label"))
        .agg(F.sum("entry.value").alias("n"))
        .groupBy("user", "round_index")
        .agg(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("entries"))
    )
    return sums.select(
        round_id(F.col("user"), F.col("round_index")).alias("round_id"),
        F.col("user").alias(user_col),
        F.map_from_entries("entries").alias("label_counts"),
    )


def finish_features(rounds: DataFrame, user_col: str, round_id_col: str, labels: list[str]) -> DataFrame:
    """The feature table's columns in their order, with duration and distance added."""
    duration = elapsed_seconds(rounds, "round_end", "round_start")
    gap = elapsed_seconds(rounds, "round_start", "prev_round_end")
    return rounds.select(
        col(round_id_col),
        col(user_col),
        "round_start",
        "round_end",
        "event_count",
        F.coalesce(duration, F.lit(0.0)).alias("duration_seconds"),
        *[col(v) for v in labels],
        "prev_round_end",
        F.coalesce(gap, F.lit(-1.0)).alias("gap_since_prev_seconds"),
    )


def _unfold_untimed(rounds: DataFrame, counts: list[str]) -> DataFrame:
    """Turn the events without a time, so far only counted, into rounds.

    The first of a user's ``untimed`` events belongs to the round that counted
    them, every other one gets a row. Event types go in sorted order, those
    without a type last. One user may have any number of them: ranges of
    ``_BLOCK`` are shuffled apart before they are written out row by row.
    """
    last = F.greatest(F.col("untimed") - 1, F.lit(0))
    blocks = F.sequence(F.lit(0), F.call_function("div", last, F.lit(_BLOCK)))
    spread = rounds.withColumn("block", F.explode(blocks)).repartition("user", "round_index", "block")
    start = F.col("block") * _BLOCK
    steps = F.sequence(start, F.least(start + (_BLOCK - 1), last))
    step = F.col("step")
    own = step == 0
    before, shares = F.lit(0), []
    for name in counts:
        upto = before + F.col(f"loose_{name}")
        hit = ((step >= before) & (step < upto)).cast("bigint")
        shares.append((F.when(own, F.col(name)).otherwise(F.lit(0)) + hit).alias(name))
        before = upto
    return spread.withColumn("step", F.explode(steps)).select(
        "user",
        (F.col("round_index") + step).alias("round_index"),
        *[F.when(own, F.col(c)).alias(c) for c in ("round_start", "round_end", "prev_round_end")],
        F.when(own, F.col("event_count")).otherwise(F.lit(0)).alias("event_count"),
        *shares,
    )


def _with_prev_end(rounds: DataFrame, user_col: str, round_id_col: str, gap: int) -> DataFrame:
    """Add the end of the user's previous round."""
    user = col(user_col)
    order = [F.col("round_start").asc_nulls_last(), col(round_id_col)]
    # Rounds without a time are kept out of their user's group, spread by their id.
    aside = F.when(F.col("round_start").isNull(), F.pmod(F.xxhash64(round_id_col), F.lit(4096)))
    if gap >= SINGLE_TASK_GAP_MICROS:
        in_time = Window.partitionBy(user, "aside").orderBy(*order)
        prev = F.when(F.col("aside").isNull(), F.lag("round_end").over(in_time))
        return rounds.withColumn("aside", aside).withColumn("prev_round_end", prev).drop("aside")

    micros = epoch_micros(rounds, "round_start")
    hour = micros - F.pmod(micros, F.lit(3600 * MICROS))
    local = Window.partitionBy(user, "hour", "aside").orderBy(*order)
    cut = (
        rounds.withColumn("hour", hour)
        .withColumn("aside", aside)
        .withColumn("local_prev", F.lag("round_end").over(local))
        .withColumn("is_first", F.row_number().over(local) == 1)
    )
    seams = (
        cut.where(F.col("hour").isNotNull())
        .groupBy(user.alias("seam_user"), F.col("hour").alias("seam_hour"))
        # Rounds of one user do not overlap, so the last end is the latest.
        .agg(F.max("round_end").alias("last_end"))
        .withColumn("seam_prev", F.lag("last_end").over(Window.partitionBy("seam_user").orderBy("seam_hour")))
    )
    prev = F.when(F.col("is_first"), F.col("seam_prev")).otherwise(F.col("local_prev"))
    return (
        cut.join(seams, (user == F.col("seam_user")) & (F.col("hour") == F.col("seam_hour")), "left")
        .withColumn("prev_round_end", F.when(F.col("aside").isNull(), prev))
        .drop("hour", "aside", "local_prev", "is_first", "seam_user", "seam_hour", "last_end", "seam_prev")
    )
