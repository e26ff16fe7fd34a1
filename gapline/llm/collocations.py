"""Phrase mining with a bidirectional FM-index per shard.

The words of a few megabytes of one language's text become a shard: a sequence of word numbers
with a 0 between pieces, kept as two Burrows-Wheeler transforms, of the sequence and of its
reverse. They are sorted by as many words as a phrase may have, which is all that intervals
of such phrases need. A phrase is an interval in both; a word to its left is an extension of
the one, a word to its right of the other, and each keeps the other in step.

Phrases are found level by level. A shard extends the phrases of m words that are frequent in
the whole corpus to the left and to the right; what both reach has m + 1 words, of which the first
m and the last m are frequent. Counts are summed across shards, and the intervals of those that are
frequent go back to their shards for the next level. So no phrase is lost, and shards send
only phrases whose parts are frequent. Nothing goes back after the last level, so there
the shards of a part of the corpus are extended by one task and send their sum. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow
from gapline.sources.scratch import written

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: Of a shorter phrase's occurrences, the hundredths that a longer one has to have to replace it.
REPLACED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words of a shard. A piece is never cut, so a text without any break makes a longer one.
SHARD_WORDS = 1 << 20
#: Most words of the shards that send one sum of their longest phrases. A task holds them packed, and their sum.
PART_WORDS = 1 << 23
#: Such parts for each core, where that makes smaller ones.
PARTS_A_CORE = 2
#: Rows that are packed at once, and rows of an index that are extended at once.
PACKED_ROWS = 1 << 19
BLOCK_ROWS = 1 << 17
#: Bytes after which an Arrow batch ends: rows of shards are megabytes, and executors keep the buffers of the largest batch.
BATCH_BYTES = 1 << 23


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (``[^\\x20\\x09]`` but for breaks) and breaks (``[.,;:!?\\x0A-\\x0D]``)."""
    breaks = np.zeros(256, bool)
    breaks[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    words = ~breaks
    words[[0x20, 0x09]] = False
    return words, breaks


WORD, BREAK = _tables()


def bounded(texts: pa.Array, is_word: np.ndarray, limit: int = tx.SLICE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The texts with longer ones than ``limit`` bytes cut between words, and whose part each is."""
    offsets, data = tx.text_bytes(texts)
    long = np.flatnonzero(np.diff(offsets) > limit)
    if not len(long):
        return texts, np.arange(len(texts))
    cuts = []
    for row in long:
        at, end = int(offsets[row]) + limit, int(offsets[row + 1])
        while at < end:
            while at < end and is_word[data[at]]:
                ahead = np.flatnonzero(~is_word[data[at : min(at + 4096, end)]])
                at = at + int(ahead[0]) if len(ahead) else min(at + 4096, end)
            if at < end:
                cuts.append(at)
            at += limit
    every = np.sort(np.concatenate((offsets, np.array(cuts, np.int64))))
    # Empty texts, which hold no words, go to the row behind them.
    owners = np.searchsorted(offsets, every[:-1], side="right") - 1
    parts = pa.LargeStringArray.from_buffers(len(every) - 1, pa.py_buffer(every.astype(np.int64)), texts.buffers()[2])
    return parts, owners


class Collector:
    """Word hashes of one language's texts, cut into shards."""

    def __init__(self, shard_words: int) -> None:
        self.limit, self.hasher = shard_words, tx.Hasher()
        self.clear()

    def clear(self) -> None:
        self.held: list[np.ndarray] = []
        self.size, self.spelled = 0, {}

    def add(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, dict[int, bytes]]]:
        """Take texts in; yields a shard's hashes, 0 before each piece, whenever there are enough."""
        parts, owners = bounded(texts, WORD)
        owner, broken = -1, True
        for first, last in tx.slices(parts):
            w = tx.words_of(parts.slice(first, last - first), WORD, self.hasher)
            breaks = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum(BREAK[w.data], out=breaks[1:])
            if not len(w.hashes):
                broken |= bool(breaks[-1])
                continue
            of = owners[first + w.texts]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
            new[0] = broken or of[0] != owner or breaks[w.starts[0]] > 0
            owner, broken = of[-1], bool(breaks[-1] > breaks[w.ends[-1]])
            if self.size >= self.limit and new.any():
                at = int(np.argmax(new))
                self._append(w, new, 0, at)
                yield self.shard()
                self._append(w, new, at, len(of))
            else:
                self._append(w, new, 0, len(of))

    def _append(self, w: tx.Words, new: np.ndarray, first: int, last: int) -> None:
        if first == last:
            return
        hashes, new = w.hashes[first:last], new[first:last]
        placed = np.zeros(len(hashes) + int(new.sum()), np.uint64)
        placed[np.arange(len(hashes)) + np.cumsum(new)] = hashes
        self.held.append(placed)
        self.size += len(hashes)
        distinct, at = np.unique(hashes, return_index=True)
        for h, k in zip(distinct.tolist(), (at + first).tolist(), strict=True):
            if h not in self.spelled:
                self.spelled[h] = w.data[w.starts[k] : w.ends[k]].tobytes()

    def shard(self) -> tuple[np.ndarray, dict[int, bytes]]:
        out = np.concatenate(self.held), self.spelled
        self.clear()
        return out


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform of a sequence that ends in 0, sorted by ``depth`` symbols."""
    order, done = symbols.astype(np.int64), 1
    while done < depth:
        if done > 1:
            order = np.unique(order, return_inverse=True)[1].astype(np.int64)
        ahead = np.zeros(len(order), np.int64)
        step = min(done, depth - done)
        ahead[: max(0, len(order) - step)] = order[step:]
        order, done = order * (int(order.max()) + 1) + ahead, done + step
    return symbols[np.argsort(order) - 1]


class Index:
    """One direction of the FM-index. Row ranges are intervals of phrases."""

    def __init__(self, bwt: np.ndarray) -> None:
        self.bwt, self.rows = bwt.astype(np.int32), len(bwt) + 1
        # In order of symbol and row: the place of (c, i) is C[c] + occ(c, i), the row of c before row i.
        self.placed = self.bwt * np.int64(self.rows)
        self.placed += np.arange(len(bwt))
        self.placed.sort()

    def extended(self, lows: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by a word of the intervals from ``lows`` on, of ``counts`` rows.

        Gives for each the interval it extends, its count, its low, and its low in the other
        direction, where the intervals' lows are ``others``.
        """
        ends, first, found = np.cumsum(counts), 0, []
        while first < len(lows):  # so many rows at once, or one interval
            after = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + BLOCK_ROWS, side="right")))
            few = slice(first, after)
            owner, *rest = self._extended(lows[few], counts[few], others[few])
            found.append((owner + first, *rest))
            first = after
        if not found:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _extended(self, lows: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        owners = np.repeat(np.arange(len(lows)), counts)
        rows = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)
        pairs, n = np.unique(owners * self.rows + self.bwt[rows], return_counts=True)
        owner, symbol = pairs // self.rows, pairs % self.rows
        before = np.cumsum(n) - n  # rows with a smaller symbol, in the same interval
        first = np.searchsorted(owner, np.arange(len(lows)))
        other = others[owner] + before - before[first][owner]
        words = symbol > 0
        owner, symbol, n, other = owner[words], symbol[words], n[words], other[words]
        return owner, n, np.searchsorted(self.placed, symbol * self.rows + lows[owner]), other


_SHARDS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("symbols", T.BinaryType()),
    ]
)
_INDEX = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("left", T.BinaryType()),
        T.StructField("right", T.BinaryType()),
        T.StructField("own_keys", T.ArrayType(T.LongType())),
        T.StructField("own_words", T.ArrayType(T.StringType())),
        T.StructField("own_f", T.ArrayType(T.LongType())),
    ]
)


def _packed(symbols: np.ndarray) -> bytes:
    """Symbols, compressed; the length comes first."""
    data = np.ascontiguousarray(symbols, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def build_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its words, the most frequent first, their counts, and the sequence of their numbers."""
    narrow = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_shards = TaskContext.get().partitionId() << 33, {}

        def row(lang: str, hashes: np.ndarray, spelled: dict[int, bytes]) -> pa.RecordBatch:
            nonlocal number
            values, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)  # a piece's 0 comes first
            order = np.argsort(-counts[1:], kind="stable")
            place = np.zeros(len(values), np.uint32)
            place[1 + order] = np.arange(1, len(values))
            words = [spelled[h].decode() for h in values[1:][order].tolist()]
            row = [lang, number, int(counts[1:].sum()), words, counts[1:][order], _packed(place[at])]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_SHARDS.names)

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pa.compute.equal(langs, lang))
                collector = open_shards.setdefault(lang, Collector(shard_words))
                for shard in collector.add(texts):
                    yield row(lang, *shard)
        for lang, collector in open_shards.items():
            if collector.size:
                yield row(lang, *collector.shard())

    return map_arrow(narrow, run, _SHARDS)


def by_shard(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows' numbers, packed: per shard a binary of 64-bit numbers for each column.

    A task packs what it has of a shard among so many rows; there are never more binaries than rows.
    """
    names = ["shard", *columns]
    schema = T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            shard, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(shard, kind="stable")
            shards, starts = np.unique(shard[order], return_index=True)
            cuts = [*starts.tolist(), len(shard)]
            binaries = [[v[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for v in values]
            return pa.RecordBatch.from_arrays([pa.array(shards), *(pa.array(b, pa.binary()) for b in binaries)], names=names)

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size >= PACKED_ROWS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return rows.select("shard", *(F.col(c).cast("long").alias(c) for c in columns)).mapInArrow(run, schema)


def _columns(packed: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a shard's packed rows."""
    return [np.concatenate([np.frombuffer(b, np.int64) for b in packed.column(c).to_pylist()]) for c in names]


def build_index(shards: DataFrame, frequent: DataFrame, depth: int) -> DataFrame:
    """Both transforms of each shard, with nothing but the words of ``frequent`` (shard, at, key, f) left.

    Other words part pieces. The shard that owns a word, and so has its ``f``, spells it.
    """
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(blobs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(blobs) or not len(found):
            return pa.table({f: pa.array([], t) for f, t in zip(_INDEX.names, kinds, strict=True)})
        at, keys, f = _columns(found, "at", "key", "f")
        words = blobs.column("words")[0].values
        place = np.zeros(len(words) + 1, np.int64)
        place[1 + at] = np.arange(1, len(at) + 1)
        symbols = np.append(place[_unpacked(blobs.column("symbols")[0].as_py())], 0)
        symbols = symbols[np.append(True, (symbols[1:] > 0) | (symbols[:-1] > 0))]  # one 0 between pieces
        shard = blobs.column("shard")[0].as_py()
        own = np.flatnonzero(f)
        row = [
            blobs.column("lang")[0].as_py(), shard, keys, _packed(transform(symbols, depth)),
            # Reversed, and with the 0 at the end again.
            _packed(transform(np.append(symbols[:-1][::-1], 0), depth)), keys[own], words.take(pa.array(at[own])).to_pylist(), f[own],
        ]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_INDEX.names)

    replies = by_shard(frequent, "at", "key", "f").groupBy("shard")
    return shards.drop("counts", "n_words").groupBy("shard").cogroup(replies).applyInArrow(run, _INDEX)


class Shard:
    """An index row: both directions, and the words' keys by number."""

    def __init__(self, left: bytes, right: bytes, keys: np.ndarray) -> None:
        self.left, self.right = Index(_unpacked(left)), Index(_unpacked(right))
        self.keys = np.append(np.int64(0), keys)

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Keys of the first and second words of all two-word phrases, low, low to the right, count."""
        counts = np.bincount(self.left.bwt, minlength=len(self.keys))
        lows = np.cumsum(counts) - counts
        return self.longer(np.array([self.keys[1:]]), lows[1:], lows[1:], counts[1:])

    def longer(self, words: np.ndarray, lows: np.ndarray, lows_right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrases longer by a word whose first words and last words are both among these (a row per word)."""
        tail, n, low, low_right = self.left.extended(lows, counts, lows_right)
        head, _, _, reached = self.right.extended(lows_right, counts, lows)
        # The same phrase, reached from its last words and from its first ones, has the same low.
        _, from_left, from_right = np.intersect1d(low, reached, assume_unique=True, return_indices=True)
        tail, head = tail[from_left], head[from_right]
        return np.vstack((words[:1, head], words[:, tail])), low[from_left], low_right[from_left], n[from_left]


def pair_keys(words: np.ndarray) -> np.ndarray:
    """A key per two-word phrase, from its words' keys."""
    first, second = words.view(np.uint64)
    return tx.mixed(tx.mixed(first) * tx.MULTIPLIER + second).view(np.int64)


def _words(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def _frequent(found: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """Rows (shard and phrase) of phrases that all shards together have often enough.

    One of a phrase's shards owns it, and has the sum ``f``; the others have 0. A phrase has a row per shard at most.
    """
    whole = Window.partitionBy(*keys)
    summed = found.withColumns({"sum": F.sum("n").over(whole), "owner": F.min("shard").over(whole)}).where(F.col("sum") >= min_count)
    return summed.withColumn("f", F.when(F.col("owner") == F.col("shard"), F.col("sum")).otherwise(0)).drop("sum", "owner")


def _shard_of(row: pa.Table | pa.RecordBatch, k: int = 0) -> Shard:
    keys = row.column("keys")[k]
    return Shard(row.column("left")[k].as_py(), row.column("right")[k].as_py(), np.array(keys.as_py(), np.int64))


def count_pairs(index: DataFrame) -> DataFrame:
    """(key, shard, n) of all two-word phrases of each shard: most of what is ever sent, so no more than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words, _, _, n = _shard_of(batch, k).pairs()
                shard = np.full(len(n), batch.column("shard")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(pair_keys(words)), pa.array(shard), pa.array(n)], names=["key", "shard", "n"])

    return index.select("shard", "keys", "left", "right").mapInArrow(run, "key long, shard long, n long")


def _with_index(index: DataFrame, replies: DataFrame, names: list[str], run: Callable) -> DataFrame:
    """What ``run`` makes of each shard and its packed replies: columns of numbers, the shard's own number with them."""

    def both(blobs: pa.Table, found: pa.Table) -> pa.Table:
        columns = run(_shard_of(blobs), found) if len(blobs) and len(found) else [np.empty(0, np.int64)] * (len(names) - 1)
        number = np.full(len(columns[0]), blobs.column("shard")[0].as_py() if len(blobs) else 0)
        return pa.table(dict(zip(names, map(pa.array, (number, *columns)), strict=True)))

    blobs = index.select("shard", "keys", "left", "right").groupBy("shard")
    return blobs.cogroup(replies.groupBy("shard")).applyInArrow(both, T.StructType([T.StructField(c, T.LongType()) for c in names]))


def spelled_pairs(index: DataFrame, found: DataFrame) -> DataFrame:
    """(shard, w1, w2, f) of the two-word phrases that shards own, from their keys."""

    def run(shard: Shard, replies: pa.Table) -> list[np.ndarray]:
        key, f = _columns(replies, "key", "f")
        words = shard.pairs()[0]
        _, own, at = np.intersect1d(pair_keys(words), key, return_indices=True)
        return [*words[:, own], f[at]]

    return _with_index(index, by_shard(found.where("f > 0"), "key", "f"), ["shard", *_words(2), "f"], run)


def _placed(words: np.ndarray, low: np.ndarray, low_right: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Columns of phrases: words, both lows as one number, count."""
    return [*words, low << 32 | low_right, n]


def _replies(frequent: DataFrame, size: int) -> DataFrame:
    return by_shard(frequent, "key") if size == 2 else by_shard(frequent, *_words(size), "place", "n")


def _extension(size: int) -> Callable:
    """Makes the columns of ``longer_phrases`` but for the shard, from a shard and its packed replies."""
    words = _words(size)

    def run(shard: Shard, replies: pa.Table) -> list[np.ndarray]:
        if size == 2:
            found, *numbers = shard.pairs()
            own = np.isin(pair_keys(found), _columns(replies, "key")[0])
            return _placed(*shard.longer(found[:, own], *(x[own] for x in numbers)))
        *found, place, n = _columns(replies, *words, "place", "n")
        return _placed(*shard.longer(np.vstack(found), place >> 32, place & 0xFFFFFFFF, n))

    return run


def longer_phrases(index: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """(shard, w1.., place, n) of phrases of ``size + 1`` words, from the frequent ones of ``size`` words.

    Those of two words are given by their keys, longer ones as this function gives them.
    """
    return _with_index(index, _replies(frequent, size), ["shard", *_words(size + 1), "place", "n"], _extension(size))


def shard_parts(shards: DataFrame, part_words: int) -> DataFrame:
    """(shard, part): shards of one language that follow each other, of ``part_words`` words and at most one shard
    more, or of fewer where all cores would not have enough parts."""
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    size = min(part_words, total // max(1, PARTS_A_CORE * shards.sparkSession.sparkContext.defaultParallelism) + 1)
    before = F.sum("n_words").over(Window.partitionBy("lang").orderBy("shard")) - F.col("n_words")
    return shards.select("shard", F.xxhash64("lang", F.floor(before / size)).alias("part"))


def longest_phrases(index: DataFrame, frequent: DataFrame, size: int, parts: DataFrame) -> DataFrame:
    """(w1.., n) of the same phrases as ``longer_phrases``, a row per phrase and part of ``parts`` (shard, part)."""
    words, run = _words(size + 1), _extension(size)
    names = [*words, "n"]

    def both(blobs: pa.Table, found: pa.Table) -> pa.Table:
        made = [pa.table({c: pa.array([], pa.int64()) for c in names})]
        for k in range(len(blobs)):
            own = found.filter(pa.compute.equal(found.column("shard"), blobs.column("shard")[k]))
            if len(own):
                *columns, _, n = run(_shard_of(blobs, k), own)
                made.append(pa.table([*map(pa.array, columns), pa.array(n)], names=names))
        summed = pa.concat_tables(made).group_by(words, use_threads=False).aggregate([("n", "sum")])
        return summed.select([*words, "n_sum"]).rename_columns(names)

    # Two numbers for each shard, which has a million words.
    parts = F.broadcast(parts)
    blobs = index.select("shard", "keys", "left", "right").join(parts, "shard").groupBy("part")
    replies = _replies(frequent, size).join(parts.withColumnRenamed("part", "of"), "shard").groupBy("of")
    return blobs.cogroup(replies).applyInArrow(both, T.StructType([T.StructField(c, T.LongType()) for c in names]))


def count_phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    shard_words: int = SHARD_WORDS,
    part_words: int = PART_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ws, f) of all phrases of up to ``max_words`` words that occur ``min_count`` times or more, (w1, lang, word)
    of their words, and (lang, n) of all word occurrences. ``ws`` are keys of words, which are a language's own."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shards = written(build_shards(docs, lang_col, text_col, shard_words), "shards")
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    each = shards.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    single = each.select(F.xxhash64("lang", "x.words").alias("key"), "shard", "at", F.col("x.counts").alias("n"))
    index = written(build_index(shards, _frequent(single, ["key"], min_count), max_words), "index")
    own = index.select("lang", F.explode(F.arrays_zip("own_keys", "own_words", "own_f")).alias("x"))
    own = own.select(F.col("x.own_keys").alias("w1"), "lang", F.col("x.own_words").alias("word"), F.col("x.own_f").alias("f"))
    grams, frequent = own.select(F.array("w1").alias("ws"), "f"), None
    for size in range(2, max_words + 1):
        words = _words(size)
        if size == 2:
            # All a shard needs to know of a pair is its key; the owner spells it.
            frequent = written(_frequent(count_pairs(index), ["key"], min_count).select("key", "shard", "f"), "pairs")
            level = spelled_pairs(index, frequent)
        elif size == max_words:
            made = longest_phrases(index, frequent, size - 1, shard_parts(shards, part_words))
            level = written(made.groupBy(*words).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), f"phrases-{size}")
        else:
            frequent = written(_frequent(longer_phrases(index, frequent, size - 1), words, min_count), f"phrases-{size}")
            level = frequent.where("f > 0")
        grams = grams.unionByName(level.select(F.array(*words).alias("ws"), "f"))
    return grams, own.drop("f"), totals


def _part(first: Column, length: Column) -> Column:
    return F.slice("ws", first, length)


def score_phrases(grams: DataFrame, replaced: int = REPLACED) -> DataFrame:
    """Phrases of two words or more with ``a, l, r, score`` of their lowest-scoring cut, but for those
    that a phrase longer by a word replaces. (A much longer one has one between that does so too.)"""
    size = F.size("ws")
    candidates = grams.where(size > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"first": _part(F.lit(1), F.col("k")), "rest": _part(F.col("k") + 1, size - F.col("k"))})
    of_first = grams.select(F.col("ws").alias("first"), F.col("f").alias("l"))
    of_rest = grams.select(F.col("ws").alias("rest"), F.col("f").alias("r"))
    # Products may pass 64 bits: decimals are exact.
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    lowest = (
        cuts.join(of_first, "first")
        .join(of_rest, "rest")
        .groupBy("ws", F.col("f").alias("a"))
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("ws", "a", "cut.l", "cut.r", "cut.score")
    )
    inside = F.explode(F.array(_part(F.lit(1), size - 1), _part(F.lit(2), size - 1))).alias("ws")
    longer = grams.where(size > 2).select("f", inside).groupBy("ws").agg(F.max("f").alias("longer"))
    kept = F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * replaced)
    return lowest.join(longer, "ws", "left").where(kept).drop("longer")


def mine_phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are cut into pieces at ``[.,;:!?]`` and line breaks, pieces into words at spaces and
    tabs, with A-Z lower-cased; phrases lie within a piece. Rows without a language are of ``und``,
    null and empty texts have no words, repeated rows count as often as they occur. Candidates are phrases
    of 2 to ``max_words`` words that occur ``min_count`` times or more (``a``). A cut into parts that
    occur ``l`` and ``r`` times has the score ``floor(2000000 * a / (l + r))``; the lowest-scoring
    cut counts, of equal ones the first. Candidates inside a longer one with at least 80 % of their
    occurrences are left out. Order: score, then ``a``, both falling, then the phrase's bytes.
    Columns other than the two named are not read. Without rows there are no phrases.
    """
    grams, words, totals = count_phrases(docs, lang_col, text_col, max_words, min_count, shard_words, part_words)
    scored = score_phrases(written(grams, "grams"))
    spelled = (
        scored.select("*", F.posexplode("ws").alias("k", "w1"))
        .join(words, "w1")
        .groupBy("lang", "ws", "a", "l", "r", "score")
        .agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("named"))
        .withColumn("phrase", F.array_join(F.transform("named", lambda x: x["word"]), " "))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
