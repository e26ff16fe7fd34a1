"""Drawing documents that look like a target: importance resampling over hashed features.

The tokenizers library's Split by a regular expression, which needs no training, gives the
words of a lower-cased text with their offsets. Runs of words are features, a feature's CRC-32
says its bucket, and how much more often the target falls into a bucket than the documents do
is the bucket's gain. A document's weight is the sum of its features' gains; with Gumbel noise
from a hash of its id added, the highest scores are a sample drawn without replacement.

Documents are tokenised once: what is kept of each is its bucket counts. Only the histograms,
a row per bucket, reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, without
from gapline.operators.rank import with_global_rank
from gapline.sources.scratch import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Characters that the library splits at once; a longer word is one block.
BLOCK = 1 << 12
#: Features whose bucket a task remembers before it starts over.
REMEMBERED = 300_000
ADDED = ("n_words", "n_features", "weight", "score", "rank")


class Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return bucket


class Featurizer:
    """Buckets of the features of a text: runs of ``shortest`` to ``longest`` words."""

    def __init__(self, buckets: int, shortest: int, longest: int) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.bucket = Buckets(buckets)
        self.shortest, self.longest = shortest, longest

    def words(self, text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """The words and their offsets, block by block; blocks end where a word does."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:
                found = BETWEEN.search(text, at + BLOCK)
                end = found.start() if found else end
            yield self.split(text[at:end])
            at = end

    def __call__(self, text: str) -> tuple[list[int], int]:
        """Buckets of the features, and the number of words."""
        # Of bytes, lower() takes A to Z only.
        lowered = text.encode().lower().decode()
        bucket, out, n_words, before = self.bucket, [], 0, []
        for block in self.words(lowered):
            n_words += len(block)
            if self.longest == 1:
                out += [bucket[word] for word, _ in block]
                continue
            words = before + [word for word, _ in block]
            for size in range(self.shortest, self.longest + 1):
                # Windows that end in this block.
                for end in range(max(size, len(before) + 1), len(words) + 1):
                    out.append(bucket[" ".join(words[end - size : end])])
            before = words[len(words) - min(len(words), self.longest - 1) :]
        return out, n_words


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, shortest: int = 1, longest: int = 1) -> DataFrame:
    """``docs`` without the text, with ``n_words, n_features`` and the lists ``buckets`` and ``counts``.

    Words are runs of anything but the ASCII characters that are neither letter nor digit, with
    A-Z lower-cased. Null and empty texts have none.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("features are runs of at least one word")
    added = ("n_words", "n_features", "buckets", "counts")
    kept = without(docs.columns, [text_col, *added])
    narrow = docs.select(*(f"`{c}`" for c in kept), f"`{text_col}`")
    number, numbers = T.LongType(), T.ArrayType(T.IntegerType())
    fields = [T.StructField(n, t) for n, t in zip(added, (number, number, numbers, numbers), strict=True)]
    schema = T.StructType([*(narrow.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(buckets, shortest, longest)
        for batch in batches:
            texts = tx.column(batch, text_col)
            for first, last in tx.slices(texts):
                found = [featurizer(t) for t in texts.slice(first, last - first).to_pylist()]
                sizes = np.array([len(b) for b, _ in found], np.int64)
                rows = np.repeat(np.arange(len(found)), sizes)
                keys, counts = np.unique(rows * buckets + np.array([b for bs, _ in found for b in bs], np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) * buckets).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % buckets, counts)
                ]
                words = pa.array([n for _, n in found], pa.int64())
                columns = batch.slice(first, last - first).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*columns, words, pa.array(sizes), *lists], names=schema.names)

    return map_arrow(narrow, run, schema)


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features per bucket. Every task sends at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(total, own, counts.astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    sums = map_arrow(counted.select("buckets", "counts"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in sums.collect()}  # a row per bucket


def gains(documents: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``, in doubles."""
    all_s, all_t = float(sum(documents.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_s / ((documents.get(b, 0) + 1.0) * all_t)))
        for b in range(buckets)
    ]


def with_weights(counted: DataFrame, gain: list[int]) -> DataFrame:
    """Add ``weight``, the sum of gains over all features; the bucket lists go."""
    columns = without(counted.columns, ["buckets", "counts", "weight"])
    narrow = counted.select(*(f"`{c}`" for c in columns), "buckets", "counts")
    schema = T.StructType([*(narrow.schema[c] for c in columns), T.StructField("weight", T.LongType())])
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts = batch.columns[-2:]
            sums = np.zeros(len(own.flatten()) + 1, np.int64)
            np.cumsum(table[own.flatten().to_numpy(zero_copy_only=False)] * counts.flatten().to_numpy(zero_copy_only=False), out=sums[1:])
            ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            weight = np.diff(sums[np.concatenate(([0], ends))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(weight)], names=schema.names)

    return map_arrow(narrow, run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    shortest: int = 1,
    longest: int = 1,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` without the text, with ``n_words, n_features, weight, score`` and ``rank``.

    ``rank`` (from 1) is given to the ``floor(percent * N / 100)`` highest scores of the N documents
    of at least ``least_words`` words, ties to the smaller id; it is null for all others. Noise is
    ``floor(-1000 * ln(-ln((h + 0.5) / 2**32)))`` with the first 32 bits ``h`` of the SHA-256 of
    ``<seed>:<id>``. A row without an id gets a weight, but neither score nor rank, and is not one of the
    N. Repeated rows count and are drawn as often as they occur; which of equal rows is drawn is open, and
    of rows that share an id the one with the smaller rank is any of those with equal scores. Columns called like the
    added ones are replaced. Without documents or target texts all gains come from the smoothing alone.
    """
    # The columns travel as one, so that their names meet no others.
    columns = without(docs.columns, [text_col, *ADDED])
    key = F.col(f"`{id_col}`")
    narrow = docs.select(F.struct(*(f"`{c}`" for c in columns)).alias("row"), key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = written(bucket_counts(narrow, "text", buckets, shortest, longest), "bucket-counts")
    aimed = bucket_counts(target.select(F.col(f"`{text_col}`").alias("text")), "text", buckets, shortest, longest)
    gain = gains(histogram(counted, buckets), histogram(aimed, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = with_weights(counted, gain).withColumn("score", F.col("weight") + noise.cast("long"))
    scored = written(scored, "scored")
    drawable = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    # A random last key spreads rows of one id over the sort's ranges; the written ranks fix the draw.
    ranked, n = with_global_rank(scored.where(drawable), [-F.col("score"), F.col("id"), F.rand(seed=seed)])
    drawn = F.when(F.col("rn") < percent * n // 100, F.col("rn") + 1).cast("long").alias("rank")
    rest = scored.where(~drawable).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, drawn).unionByName(rest).select("row.*", *ADDED)
