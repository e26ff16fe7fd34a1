"""Column names, types and checks shared by all modules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER = "user_id"
TIME = "recorded_at"
LABEL = "event_type"
DEFAULT_GAP_MINUTES = 30

# Fixed column names of the sessionized log and of the feature table.
ROUND_COLUMNS = ["round_index", "round_id", "round_start", "round_end", "event_count"]
FEATURE_COLUMNS = [
    "round_id",
    "round_start",
    "round_end",
    "event_count",
    "duration_seconds",
    "prev_round_end",
    "gap_since_prev_seconds",
]

RECORDINGS_SCHEMA = T.StructType(
    [
        T.StructField(USER, T.StringType()),
        T.StructField(TIME, T.StringType()),
        T.StructField(LABEL, T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def reject_names(names: Iterable[str], taken: Iterable[str], what: str) -> None:
    """Raise if a name is taken, or two names are one, by the session's rule on upper and lower case."""
    spark = SparkSession.getActiveSession()
    strict = spark is not None and spark.conf.get("spark.sql.caseSensitive") == "true"

    def key(name: str) -> str:
        return name if strict else name.lower()

    names, used = list(names), {key(t) for t in taken}
    clash = sorted(n for n in names if key(n) in used)
    if clash:
        raise ValueError(f"{what} {clash} would collide with columns of the result")
    alike = sorted(n for n in set(names) if sum(key(m) == key(n) for m in set(names)) > 1)
    if alike:
        raise ValueError(f"{what} {alike} differ in upper and lower case only, and would be one column")


def unused(wish: str, *tables: DataFrame) -> str:
    """``wish``, made longer until no column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
