"""Reading event logs and reading and writing feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.schema import col

# A header that differs from the schema and a line that does not fit it are errors.
CSV_OPTIONS = {"header": "true", "enforceSchema": "false", "mode": "FAILFAST"}
MALFORMED = "malformed_line"
# Spellings that mean "missing" in recordings files.
MISSING_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_recordings(
    spark: SparkSession,
    source: str | list[str],
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    malformed: str = "fail",
) -> DataFrame:
    """Scan recordings from CSV files with a header, or from Parquet.

    Without a ``schema`` the types of CSV columns are inferred, which reads the
    files one more time; at scale give one (``gapline.schema.RECORDINGS_SCHEMA``).
    Keep the time column a string there, so that malformed times are seen rather
    than read as null.

    A CSV line with too many or too few fields, or a field that is not of its column's type, fails
    the scan; with ``malformed="keep"`` it has the line in a column ``malformed_line``, null elsewhere
    (see :func:`gapline.sources.rejects.tag_rejects`).
    """
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(*([source] if isinstance(source, str) else source))
    if fmt != "csv":
        raise ValueError(f"unknown recordings format {fmt!r}")
    reader = spark.read.options(**CSV_OPTIONS)
    if malformed == "keep":
        if schema is None:
            schema = reader.option("inferSchema", True).option("mode", "PERMISSIVE").csv(source).schema
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*fields.fields, T.StructField(MALFORMED, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    elif malformed != "fail":
        raise ValueError(f"malformed is {malformed!r}, neither 'fail' nor 'keep'")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return blank_to_null(whole_lines(reader.csv(source)))


def recordings_stream(
    spark: SparkSession, source: str, schema: T.StructType | str, fmt: str = "parquet", options: dict[str, str] | None = None
) -> DataFrame:
    """Recordings as they arrive under ``source``, by the same rules; each file is read once."""
    given = (CSV_OPTIONS if fmt == "csv" else {}) | (options or {})
    events = spark.readStream.schema(schema).options(**given).format(fmt).load(source)
    return blank_to_null(whole_lines(events)) if fmt == "csv" else events


def whole_lines(df: DataFrame) -> DataFrame:
    """The rows, with all columns read: a scan of some would not see damage in the others."""
    return df.where(F.size(F.array(*[col(c).isNull() for c in df.columns])) > 0)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Texts that are spellings of "missing" as null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != MALFORMED]
    cleaned = {
        c: F.when(~col(c).isin(MISSING_SPELLINGS), col(c)) for c in texts
    }
    return df.withColumns(cleaned) if cleaned else df


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(
    features: DataFrame, path: str, mode: str = "overwrite", sort_by: list[str] | None = None
) -> None:
    """Write Parquet. ``mode='ignore'`` keeps an existing table and runs nothing.

    ``sort_by`` orders rows within each file, which makes later filters on these
    columns skip row groups. A table cannot be overwritten while it is read.
    """
    if sort_by:
        features = features.sortWithinPartitions(*sort_by)
    features.write.mode(mode).parquet(path)


def save_by_user(features: DataFrame, table: str, user_col: str, buckets: int = 200, mode: str = "overwrite") -> DataFrame:
    """Save a feature table bucketed by user and sorted by start, and read it back by its name.

    Steps that gather a user's rounds (``latest_rounds``, distances to the round before) then read each
    bucket where it is, without a shuffle. ``buckets`` bounds their parallelism: give about the size of
    the table over 200 MB. The table lies in the session's warehouse, which all executors must share.
    """
    by_user = features.repartition(buckets, col(user_col))  # one file per bucket
    by_user.write.bucketBy(buckets, user_col).sortBy(user_col, "round_start").mode(mode).format("parquet").saveAsTable(table)
    return features.sparkSession.table(table)
