"""URL filters: a range join of urls with host and path rules, by a sorted sweep.

Hosts are written from the top label down (``www.example.com`` as ``com.example.www.``).
For every number of labels that rule hosts have, a url has one key: that many labels,
then its path. All urls that a rule fits then stand in one interval of sorted keys,
right behind the rule, and such intervals are nested or apart. A sweep over rules and
urls in key order needs, per number of labels, just the last rule passed: its stack of
enclosing rules holds every rule that can fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapline.llm.frames import unused_name, without

Rule = tuple[str, str, str]  # verdict, host, path


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table: verdict, host, path."""
    rows = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(n) for n in ("verdict", "host", "path")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, depth: int | Column, path: Column) -> Column:
    return F.concat(F.array_join(F.slice(labels, 1, depth), "."), F.lit("."), path)


def _with_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule: labels, key, and the stack of rules whose interval holds it, itself included.

    Rules that are written twice count once; an allowing one wins over a blocking one.
    """
    unique = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
    )
    keyed = unique.withColumn("depth", F.size(F.split("host", r"\."))).select(
        "depth", _key(_reversed(F.col("host")), F.col("depth"), F.col("path")).alias("key"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            _key(_reversed(F.col("host")), F.col("depth"), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("held"),
    )
    prefixes = keyed.select(
        "depth", F.col("key").alias("full"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"),
    )
    return (
        prefixes.join(keyed, ["depth", "key"])
        .groupBy("depth", F.col("full").alias("key"))
        .agg(F.collect_list("held").alias("stack"))
    )


def _still_open(stack: Column, key: Column) -> Column:
    """The rules of a stack whose interval holds the key."""
    return F.filter(stack, lambda rule: F.startswith(key, rule["key"]))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    spread_by: Sequence[str] = (),
    default: str = "allow",
    buckets: int | None = None,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    A rule fits its host and all hosts below it, where the path starts with the rule's
    path. The longest rule (host and path together, then host) wins. Where none fits, or
    the url is null or has no ``://`` (both parts are then empty), ``rule`` is null and
    ``verdict`` is ``default``. Rows are never merged; a page column called like one of the
    four results is replaced. Empty tables give empty results or no fitting rule.

    Pages are dealt to ``buckets`` by a hash of the url and ``spread_by`` (give an id, so
    that copies of one url part), never by host, so one site may hold most rows. Each
    bucket sweeps all rules: rules are copied once per bucket. Nothing is broadcast.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = _with_stacks(rules)
    depths = sorted(r[0] for r in stacks.select("depth").distinct().collect())  # at most 127 in host names
    results = ("host", "path", "rule", "verdict")
    kept = without(pages.columns, results)
    row = unused_name("_row", kept)
    pages = pages.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias(row) if kept else F.struct(F.lit(0).alias("none")).alias(row),
        url_host(F.col(f"`{url_col}`")).alias("host"),
        url_path(F.col(f"`{url_col}`")).alias("path"),
        F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in dict.fromkeys((url_col, *spread_by)))), F.lit(buckets)).alias("bucket"),
    )
    labels = F.when(F.col("host") != "", _reversed(F.col("host")))
    for d in depths:
        pages = pages.withColumn(f"key_{d}", F.when(F.size(labels) >= d, _key(labels, d, F.col("path"))))
    spread = stacks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).select(
        F.col("bucket").cast("long"), "stack", *(F.when(F.col("depth") == d, F.col("key")).alias(f"key_{d}") for d in depths)
    )
    swept = pages.unionByName(spread, allowMissingColumns=True)
    for d in depths:
        passed = Window.partitionBy("bucket").orderBy(F.col(f"key_{d}").asc_nulls_first(), F.col("stack").isNull())
        rows = passed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(F.when(F.col(f"key_{d}").isNotNull(), F.col("stack")), ignorenulls=True).over(rows)
        swept = swept.withColumn(f"last_{d}", last)
    nothing = F.lit(None).cast(stacks.schema["stack"].dataType)
    fits = [_still_open(F.col(f"last_{d}"), F.col(f"key_{d}")) for d in depths]
    found = F.concat(*(F.coalesce(f, F.array().cast(stacks.schema["stack"].dataType)) for f in fits)) if fits else nothing
    best = F.array_max(found)
    swept = swept.where(F.col(row).isNotNull())
    swept = swept.withColumn("best", best)
    return swept.select(
        *(F.col(f"{row}.`{c}`").alias(c) for c in kept), "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
