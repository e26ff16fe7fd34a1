"""Language-model scores by deleted interpolation of bigrams and unigrams.

Documents are dealt to batches by id. Every batch sends its distinct n-grams, as hashes
with their counts in training documents, to the shards that own them; a shard adds up what
it is sent and answers every batch with the totals. So a batch knows the counts of each of
its tokens without a row per token being shuffled, and no table of counts is collected.

Mixture weights, one set per bucket of context frequency, are learned by expectation-
maximisation on deleted counts: each training token is predicted from all others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow
from gapline.sources.scratch import written

#: Characters of a batch of documents, and of the corpus per shard of n-grams.
BATCH_CHARS = 16 << 20
SHARD_CHARS = 16 << 20
ADDED = 0.1
#: Steps per factor 2 in which count ratios are gathered for the weights.
STEPS = 4
END = np.uint64(0x5EED_0E0D)
START = np.uint64(0x5EED_57A7)

_REQUEST = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("single", pa.bool_()), ("grams", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("single", pa.bool_()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])
_COUNTED = pa.schema(
    [("doc", pa.int64()), ("taught", pa.bool_()), ("singles", pa.binary()), ("pairs", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())]
)


class Tokens(NamedTuple):
    """Tokens of a batch: hash, hash with the token before, text; tokens per text."""

    single: np.ndarray
    pairs: np.ndarray
    texts: np.ndarray
    counts: np.ndarray


def tokens_of(texts: pa.Array, hasher: tx.Hasher) -> Tokens:
    """Words (runs of anything but space and the controls 9 to 13; A-Z lower-cased), then one end."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, last in tx.slices(texts):
        w = tx.words_of(texts.slice(first, last - first), tx.SPACED, hasher)
        counts = w.counts + 1
        ends = np.cumsum(counts) - 1
        single = np.empty(counts.sum(), np.uint64)
        single[ends] = END
        inner = np.ones(len(single), bool)
        inner[ends] = False
        single[inner] = w.hashes
        before = np.concatenate(([START], single[:-1]))
        before[(ends + 1)[:-1]] = START
        parts.append((single, tx.mixed(before * tx.MULTIPLIER + single), counts))
    if not parts:
        empty = np.empty(0, np.uint64)
        return Tokens(empty, empty, np.empty(0, np.int64), np.empty(0, np.int64))
    single, pairs, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Tokens(single, pairs, np.repeat(np.arange(len(counts)), counts), counts)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all, which leaves runs of zeros where numbers are small."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _owned(distinct: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, after) of sorted hashes: a shard owns an interval of hashes."""
    if len(distinct):
        owner = (distinct >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(distinct)]
        yield from zip(owner[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True)


def _requests(batch: int, texts: pa.Array, taught: np.ndarray, shards: int) -> Iterator[dict]:
    t = tokens_of(texts, tx.Hasher())
    learned = taught[t.texts]
    for single, grams in ((True, t.single), (False, t.pairs)):
        distinct, at = np.unique(grams, return_inverse=True)
        counts = np.bincount(at[learned], minlength=len(distinct))
        for shard, a, b in _owned(distinct, shards):
            steps = np.diff(distinct[a:b], prepend=np.uint64(0))
            yield {"batch": batch, "shard": shard, "single": single, "grams": _planes(steps), "counts": _planes(counts[a:b])}


def _totals(requests: list[dict]) -> Iterator[dict]:
    """Answers of one shard: the totals of what each batch asked for, in its order."""
    for single in (True, False):
        own = sorted((r for r in requests if r["single"] == single), key=lambda r: r["batch"])
        if not own:
            continue
        grams = [np.cumsum(_numbers(r["grams"]), dtype=np.uint64) for r in own]
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate([_numbers(r["counts"]) for r in own])
        sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        types, tokens = (int((sums > 0).sum()), int(sums.sum())) if single else (0, 0)
        after = 0
        for r, g in zip(own, grams, strict=True):
            before, after = after, after + len(g)
            # The shard's own sums of single tokens go out once, with its first answer.
            yield r | {"types": types, "tokens": tokens, "counts": _planes(sums[at[before:after]])}
            types = tokens = 0


def _counts(t: Tokens, answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of each token, and of each with the token before."""
    known = {(r["single"], r["shard"]): r["counts"] for r in answers}
    out = []
    for single, grams in ((True, t.single), (False, t.pairs)):
        distinct, at = np.unique(grams, return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        for shard, a, b in _owned(distinct, shards):
            totals[a:b] = _numbers(known[single, shard]).astype(np.int64)
        out.append(totals[at])
    return out[0], out[1]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one per factor 2 of its count."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


class Weights(NamedTuple):
    """Per bucket of context frequency: weights of bigram, unigram and uniform estimate."""

    mix: np.ndarray
    tokens: int
    types: int
    starts: int


def counted(docs: DataFrame, taught: Column, id_col: str, text_col: str) -> tuple[DataFrame, int, int, int]:
    """Per document its tokens' training counts; N, the number of types, and of training documents.

    Written, so that weights and scores read counts only. Batches hold about ``BATCH_CHARS``
    characters, shards are owed the n-grams of ``SHARD_CHARS``: tasks need the same memory at any size.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")) + F.lit(1))).first()[0] or 0
    batches, shards = max(1, math.ceil(chars / BATCH_CHARS)), max(1, math.ceil(chars / SHARD_CHARS))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.substring(F.col(f"`{text_col}`"), 1, 64)), F.lit(batches)).alias("batch"),
        F.col(f"`{id_col}`").alias("doc"), F.coalesce(taught, F.lit(False)).alias("taught"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def ask(table: pa.Table) -> pa.Table:
        batch = _one_batch(table)
        learned = np.asarray(batch.column("taught").to_pylist(), bool)
        found = _requests(batch.column("batch")[0].as_py(), batch.column("text"), learned, shards)
        return pa.Table.from_pylist(list(found), _REQUEST)

    def answer(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{k: r[k] for k in _ANSWER.names} for r in _totals(table.to_pylist())], _ANSWER)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        batch, answers = _one_batch(left), right.to_pylist()
        t = tokens_of(batch.column("text"), tx.Hasher())
        singles, pairs = _counts(t, answers, shards)
        ends = np.cumsum(t.counts)
        cut = list(zip((ends - t.counts).tolist(), ends.tolist(), strict=True))
        sums = [[sum(r[k] for r in answers), *([0] * (len(cut) - 1))] for k in ("types", "tokens")]
        columns = [
            batch.column("doc").cast(pa.int64()), batch.column("taught"),
            *(pa.array([_planes(c[a:b]) for a, b in cut], pa.binary()) for c in (singles, pairs)), *(pa.array(x, pa.int64()) for x in sums),
        ]
        return pa.Table.from_arrays(columns, schema=_COUNTED)

    answers = rows.groupBy("batch").applyInArrow(ask, from_arrow_schema(_REQUEST)).groupBy("shard").applyInArrow(answer, from_arrow_schema(_ANSWER))
    counts = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(count, from_arrow_schema(_COUNTED))
    counts = written(counts, "token-counts")
    sums = counts.agg(F.sum("tokens"), F.sum("types"), F.count(F.when(F.col("taught"), 1))).first()
    return counts.drop("types", "tokens"), sums[0] or 0, sums[1] or 0, sums[2]


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _contexts(singles: np.ndarray, starts: int) -> np.ndarray:
    """Count of each token's context: of the token before, or of all starts."""
    return np.concatenate(([starts], singles[:-1]))


def learn_weights(counts: DataFrame, tokens: int, types: int, starts: int, rounds: int = 50) -> Weights:
    """Expectation-maximisation over all training tokens, each deleted from the counts that predict it.

    Tokens are gathered by bucket and by the ratios of their three estimates, in steps of a
    quarter of a factor 2: a table bounded by the range of 64-bit counts, whatever the corpus.
    """
    schema = "bucket int, high int, low int, n long"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for s, p in zip(batch.column("singles"), batch.column("pairs"), strict=True):
                singles, pairs = _numbers(s.as_py()).astype(np.int64), _numbers(p.as_py()).astype(np.int64)
                context = _contexts(singles, starts) - 1
                uniform = 1 / (types + 1)
                high = _step(np.divide(pairs - 1, context, out=np.zeros(len(pairs)), where=context > 0) / uniform)
                low = _step((singles - 1) / max(tokens - 1, 1) / uniform)
                keys, n = np.unique(np.stack((_bucket(context), high, low)), axis=1, return_counts=True)
                for key, k in zip(keys.T.tolist(), n.tolist(), strict=True):
                    cells[tuple(key)] = cells.get(tuple(key), 0) + k
        if cells:
            columns = [pa.array(c, pa.int32()) for c in zip(*cells, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(cells.values()), pa.int64())], names=["bucket", "high", "low", "n"])

    cells = map_arrow(counts.where("taught"), gather, schema).groupBy("bucket", "high", "low").agg(F.sum("n").alias("n")).toPandas()
    mix = np.full((65, 3), 1 / 3)
    for bucket, own in cells.groupby("bucket"):
        estimates = np.stack((_value(own["high"].to_numpy()), _value(own["low"].to_numpy()), np.ones(len(own))), 1)
        n = own["n"].to_numpy()
        for _ in range(rounds):
            share = estimates * mix[bucket]
            share *= (n / share.sum(1))[:, None]
            mix[bucket] = share.sum(0) / n.sum()
    mix[0, 0] = 0.0  # a context never seen has no bigrams
    mix = np.maximum(mix, [[0.0, 0.0, 1e-9]])
    return Weights(mix / mix.sum(1, keepdims=True), tokens, types, starts)


_NONE = -(1 << 20)


def _step(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300)) * STEPS), _NONE).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step == _NONE, 0.0, 2.0 ** (np.where(step == _NONE, 0, step) / STEPS))


def probabilities(singles: np.ndarray, pairs: np.ndarray, w: Weights) -> np.ndarray:
    """The model's probability of each token of a text."""
    context = _contexts(singles, w.starts)
    high = np.divide(pairs, context, out=np.zeros(len(pairs)), where=context > 0)
    low = singles / max(w.tokens, 1)
    mix = w.mix[_bucket(context)]
    return mix[:, 0] * high + mix[:, 1] * low + mix[:, 2] / (w.types + 1)


def score_documents(docs: DataFrame, taught: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``taught`` is true (null counts as false) and scores all
    rows, repeated ones included. Null texts are empty: one token, the end. ``score`` is the log10
    probability of the text; ``base_score`` that of the unigrams with 0.1 added to every count.
    Tokens are known by 64-bit hashes. With nothing to learn from, all tokens have the uniform probability.
    """
    counts, tokens, types, starts = counted(docs, taught, id_col, text_col)
    weights = learn_weights(counts, tokens, types, starts)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, learned, s, p in zip(*(batch.column(k) for k in range(4)), strict=True):
                singles, pairs = _numbers(s.as_py()).astype(np.int64), _numbers(p.as_py()).astype(np.int64)
                base = np.log10((singles + ADDED) / (tokens + ADDED * (types + 1))).sum()
                score = np.log10(probabilities(singles, pairs, weights)).sum()
                rows.append((doc.as_py(), not learned.as_py(), len(singles), int((singles > 0).sum()), tokens, float(base), float(score)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_arrow(counts, run, schema)
