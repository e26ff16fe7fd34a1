"""Quality rules: failures per document, shrunk failure rates and verdicts per host.

Every document is judged by a few rules. Failures are summed by host, each host's rate is
shrunk towards the mean of all hosts by a beta prior fitted to the hosts' rates, and a
host that almost surely fails a rule far more often than hosts do takes all its documents
with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, unused_name, without
from gapline.sources.scratch import written

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 3

#: Rules over the features. The first two are the base rules: a document that fails one is not kept.
BASE_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
}
HOST_RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > 5 * word_chars",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
}
#: The rule of failing any of them.
ANY_RULE = "any_rule"
#: Standard deviations from a beta distribution's mean to what counts as its lower and upper end.
ENDS = 2.0
#: Bounds of the rate from which on a host is rejected; between them it is the upper end of the prior.
LEAST_LIMIT, MOST_LIMIT = 0.6, 0.8


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the lines that are not empty."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    ends = offsets[rows + 1]
    following = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(ends, following)
    some = ends > starts
    return starts[some], ends[some], rows[some]


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_index=True)[1]


def _features(texts: pa.Array, hasher: tx.Hasher) -> dict[str, np.ndarray]:
    w = tx.words_of(texts, tx.SPACED, hasher, lower=False)
    n = len(texts)
    inside = tx.SPACED[w.data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    salt = tx.mixed(np.arange(1, n + 1, dtype=np.uint64))
    starts, ends, rows = _lines(w.data, w.offsets)
    counted = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(inside, out=counted[1:])
    worded = counted[ends] > counted[starts]
    starts, ends, rows = starts[worded], ends[worded], rows[worded]
    line_keys = tx.mixed(hasher(w.data, starts, ends) + salt[rows])
    n_lines = np.bincount(rows, minlength=n)
    distinct = np.bincount(rows[_first_of_each(line_keys)], minlength=n)
    keys, whole = tx.windows(w.hashes, w.texts, WINDOW)
    places = np.flatnonzero(whole)
    keys = tx.mixed(keys[places] + salt[w.texts[places]])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.hashes), bool)
    for k in range(WINDOW):
        covered[places[twice] + k] = True
    return {
        "n_words": w.counts,
        "word_chars": tx.summed(inside & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": tx.summed(symbol[w.data], w.offsets),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": np.bincount(w.texts[covered], minlength=n),
    }


def document_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the features of each text to ``docs``; columns of their names are replaced.

    Words are runs of anything but space and the controls 9 to 13. ``word_chars`` counts their
    code points, ``n_symbols`` characters of ``#*$%&|<>``, ``n_lines`` lines with a word,
    ``n_dup_lines`` those equal to an earlier one, ``n_repeat_words`` words in 3-word windows
    that the text has twice or more. All are 0 for a null or empty text.
    """
    kept = docs.select(*(f"`{c}`" for c in without(docs.columns, FEATURES)))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher()
        for batch in batches:
            texts = tx.column(batch, text_col)
            for first, last in tx.slices(texts):
                found = _features(texts.slice(first, last - first), hasher)
                added = {k: pa.array(v, pa.int64()) for k, v in found.items()}
                yield tx.with_columns(batch.slice(first, last - first), **added)

    return map_arrow(kept, run, schema)


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({rule})" for rule in BASE_RULES.values()))


def host_verdicts(features: DataFrame, host_col: str = "source", least_limit: float = LEAST_LIMIT, most_limit: float = MOST_LIMIT) -> DataFrame:
    """One row per host: documents, shrunk rate per rule and of failing any, and ``host_rejected``.

    The prior of a rule is the beta distribution with the mean of the hosts' rates and their
    variance, less what the hosts' sizes explain by chance; hosts that do not differ by more
    than that are given the mean. A host is rejected if, for some rule, the lower end of its rate's
    posterior reaches the upper end of the prior, held between ``least_limit`` and ``most_limit``. So a
    host needs documents enough to be sure of its rate, and at most two fifths of the documents that
    fall with it fail no rule. Documents without a host belong to none. Just the means and
    variances (a few numbers per rule) reach the driver.
    """
    rules = HOST_RULES | {ANY_RULE: " OR ".join(f"({rule})" for rule in HOST_RULES.values())}
    fails = [F.avg(F.expr(rule).cast("double")).alias(f"rate_{name}") for name, rule in rules.items()]
    hosts = (
        features.where(F.col(f"`{host_col}`").isNotNull())
        .groupBy(F.col(f"`{host_col}`").alias("host"))
        .agg(F.count("*").alias("host_documents"), *fails)
    )
    hosts = written(hosts, "hosts")
    moments = [
        f(F.col(f"rate_{name}")).alias(f"{short}_{name}")
        for name in rules
        for short, f in (("mean", F.avg), ("var", F.var_pop))
    ]
    row = hosts.agg(*moments, F.avg(1 / F.col("host_documents")).alias("noise")).first()
    rejected, rates = F.lit(False), []
    for name in rules:
        mean = row[f"mean_{name}"]
        if mean is None:  # no hosts
            break
        spread = mean * (1 - mean)
        extra = row[f"var_{name}"] - spread * row["noise"]
        strength = min(max(spread / extra - 1, 1.0), 1e9) if extra > 0 else 1e9
        limit = min(max(mean + ENDS * math.sqrt(spread / (strength + 1)), least_limit), most_limit)
        seen = F.col("host_documents") + strength
        rate = (F.col(f"rate_{name}") * F.col("host_documents") + mean * strength) / seen
        rates.append(rate.alias(f"shrunk_{name}"))
        surely = rate - ENDS * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (seen + 1))
        rejected = rejected | (surely >= limit)
    return hosts.select("host", "host_documents", *rates, rejected.alias("host_rejected"))


def with_verdicts(features: DataFrame, hosts: DataFrame, host_col: str = "source") -> DataFrame:
    """Add ``base_failed``, ``host_rejected`` and ``kept`` to documents with features.

    A document is kept if it fails no base rule and its host is not rejected; without a host
    the base rules alone decide. The join is Spark's choice: hosts are a written table, whose
    size is known when it is planned, and a hot host's rows can be split.
    """
    rejected, host = unused_name("host_rejected", features.columns), unused_name("_host", features.columns)
    hosts = hosts.where("host_rejected").select(F.col("host").alias(host))
    hosts = written(hosts, "rejected-hosts").withColumn(rejected, F.lit(True))
    joined = features.join(hosts, F.col(f"`{host_col}`") == F.col(host), "left").drop(host)
    joined = joined.withColumn(rejected, F.coalesce(rejected, F.lit(False))).withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col(rejected))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Documents with features and verdicts.

    The text is read twice: for the hosts' counts, and again for the result, so that no text
    is shuffled. Repeated rows stay and count as often as they occur.
    """
    narrow = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("host"))
    hosts = host_verdicts(document_features(narrow), "host")
    return with_verdicts(document_features(docs, text_col), hosts, host_col)
