"""Spark session with the settings the package is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything here is a default: a value already given by spark-submit, the
# cluster or the caller wins.
_DEFAULTS = {
    # Elapsed time, not wall-clock time.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot (user, cell) of the event join over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sizes estimated before a query runs prove nothing. Joins are shuffled; what is
    # broadcast is marked in the code and bounded by something other than the data.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    # Lets the event join skip the sort of the wide side, but only where every
    # build partition was measured to be below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}

# Recording the Python call site of every expression doubles the time it takes to
# build a plan. Can only be set when the session is made; give "true" to debug.
_DEBUGGING = "spark.python.sql.dataFrameDebugging.enabled"


def make_session(
    app_name: str = "gapline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
    scratch: str | None = None,
) -> SparkSession:
    """Build a session.

    ``shuffle_partitions`` is the count before adaptive coalescing: leave it to
    the cluster's setting, or give about 2-3 times the total number of cores,
    more if the shuffled data exceeds ~200 MB per partition. ``scratch`` is the folder
    for intermediate tables and checkpoints, in storage that all executors share.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = dict(conf or {})
    if scratch:
        given.setdefault("spark.checkpoint.dir", scratch)
    if shuffle_partitions:
        given.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in ({_DEBUGGING: "false"} | given).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()} | given.keys()
    for key, value in _DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark
