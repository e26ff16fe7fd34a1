"""Small helpers of the operators over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of an Arrow batch. Spark's own default, 10,000 rows, is too much memory for long texts.
BATCH_ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unused_name(wish: str, taken: Iterable[str]) -> str:
    """``wish``, made longer until no column is called so, in any case."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


def without(columns: Iterable[str], names: Iterable[str]) -> list[str]:
    """The columns that are called like none of the names, in any case."""
    left_out = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in left_out]


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    The bound is a setting of the session, as it counts when the plan is run; a lower one stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
