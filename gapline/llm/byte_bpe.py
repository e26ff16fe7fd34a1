"""Byte-level BPE by tree reduction.

A span of text has an encoding, and two neighbours' encodings can be joined into that of both
together, so a text is encoded by halves, whatever the order in which they are joined. Two things
can change where spans meet:

- *Matches* of the vocabulary's pattern. Those at the left span's end that could go on are matched
  again, together with as much of the right span as it takes until a match that is settled ends where
  one of the right span's own ends. Matching looks ahead but never back, so from there on the right
  span's matches are right.
- *Tokens* within one match that is too long to be encoded at once. Its halves are encoded, and
  tokens around the middle are encoded again in a growing window. A sequence of tokens is the
  encoding if each two neighbours, encoded together, stay as they are: the first merge over a
  border would show in the pair already. So the window may stop once its outer tokens and their
  neighbours stay.

Texts of more than ``GIANT`` characters are cut up, their chunks encoded wherever there is room, and
joined by a few per task, level by level. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, unused_name, without
from gapline.sources.scratch import written

#: Characters of a leaf of the tree, and of a chunk of a giant text.
LEAF = 1 << 13
GIANT = 1 << 20
#: Neighbouring chunks that a task joins.
FAN = 8
#: Bytes of a match that is encoded at once.
LONG = 512
#: Matches that a task remembers before it starts over.
REMEMBERED = 200_000
#: Characters, at most, that decide whether a match is one of the pattern's fixed ones ('re).
AHEAD = 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of byte strings: lines of a base64 string and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Matches(dict):
    """Ids of a match, remembered; none for a match that is encoded later, by halves."""

    def __init__(self, encode: Callable[[bytes], list[int]], longest: int) -> None:
        super().__init__()
        self.encode, self.longest = encode, longest

    def __missing__(self, match: str) -> list[int] | None:
        data = match.encode()
        if len(data) > self.longest:
            return None
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[match] = self.encode(data)
        return ids


class Part:
    """A span's encoding: its matches, each with its ids (None if it is long)."""

    __slots__ = ("matches", "ids")

    def __init__(self, matches: list[str], ids: list[list[int] | None]) -> None:
        self.matches, self.ids = matches, ids

    def unsettled(self) -> int:
        """How many of the last matches could be others if the text went on."""
        n, length = 0, 0
        # The last one may grow; those before it stand if what could make them longer is in the span.
        while n < len(self.matches) and (n == 0 or length < AHEAD):
            n += 1
            length += len(self.matches[-n])
        return n


class ByteEncoder:
    """Encodes texts as the tiktoken library does with these ranks and this pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, long: int = LONG) -> None:
        import regex
        import tiktoken

        self.ranks, self.leaf = ranks, leaf
        library = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode_bytes: Callable[[bytes], list[int]] = library._encode_single_piece
        self.tokens = {n: t for t, n in ranks.items()}
        # Halves of a long match must be longer than any token: a token is looked up, not merged.
        self.long = max(long, 2 * max(map(len, ranks)) + 2)
        self.found = regex.compile(pattern).findall
        self.known = Matches(self.encode_bytes, self.long)

    # --- matches

    def part(self, text: str) -> Part:
        """The encoding of a span, by halves."""
        if len(text) <= self.leaf:
            return self.matched(self.found(text))
        middle = len(text) // 2
        return self.joined(self.part(text[:middle]), self.part(text[middle:]))

    def matched(self, matches: list[str]) -> Part:
        known = self.known
        return Part(matches, [known[m] for m in matches])

    def joined(self, a: Part, b: Part) -> Part:
        if not a.matches or not b.matches:
            return a if a.matches else b
        stands = len(a.matches) - a.unsettled()
        tail = "".join(a.matches[stands:])
        ends = list(accumulate(map(len, b.matches), initial=len(tail)))  # where b's matches begin
        taken = 1
        while True:
            window = tail + "".join(b.matches[:taken])
            found = self.found(window)
            used = self._met(found, len(window), ends, taken)
            if used is None and taken < len(b.matches):
                taken = min(2 * taken, len(b.matches))
                continue
            count, rest = used if used else (len(found), len(b.matches))
            new = self.matched(found[:count])
            return Part(a.matches[:stands] + new.matches + b.matches[rest:], a.ids[:stands] + new.ids + b.ids[rest:])

    @staticmethod
    def _met(found: list[str], length: int, ends: list[int], taken: int) -> tuple[int, int] | None:
        """The first settled matches of a window that end where matches of the right span begin."""
        borders = {end: k for k, end in enumerate(ends[: taken + 1])}
        start = 0
        for count, match in enumerate(found, 1):
            end = start + len(match)
            if end >= length or start + AHEAD > length:
                return None
            if end in borders:
                return count, borders[end]
            start = end
        return None

    # --- tokens of long matches

    def _stays(self, left: int, right: int) -> bool:
        return self.encode_bytes(self.tokens[left] + self.tokens[right]) == [left, right]

    def long_ids(self, data: bytes) -> list[int]:
        """Ids of a match, by halves."""
        if len(data) <= self.long:
            return self.encode_bytes(data)
        middle = len(data) // 2
        return self.joined_ids(self.long_ids(data[:middle]), self.long_ids(data[middle:]))

    def joined_ids(self, a: list[int], b: list[int]) -> list[int]:
        if self._stays(a[-1], b[0]):
            return a + b
        width = 1
        while True:
            i, j = min(width, len(a)), min(width, len(b))
            data = b"".join(self.tokens[n] for n in chain(a[len(a) - i :], b[:j]))
            new = self.encode_bytes(data)
            whole = i == len(a) and j == len(b)
            if whole or (
                data not in self.ranks
                and (i == len(a) or self._stays(a[len(a) - i - 1], new[0]))
                and (j == len(b) or self._stays(new[-1], b[j]))
            ):
                return a[: len(a) - i] + new + b[j:]
            width *= 2

    def ids(self, part: Part) -> list[int]:
        """All ids of a finished text."""
        lists = part.ids
        if None in lists:
            lists = [self.long_ids(m.encode()) if x is None else x for m, x in zip(part.matches, lists, strict=True)]
        return list(chain.from_iterable(lists))

    def __call__(self, text: str) -> list[int]:
        return self.ids(self.part(text))


# A part as a row: the text, the characters of each match, the ids of each (-1: a long match), end to end.
_PARTS = pa.schema(
    [("row", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))]
)
_CHUNKS = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("text", pa.string())])
_IDS = pa.schema([("row", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _as_row(row: int, k: int, part: Part) -> dict:
    return {
        "row": row, "k": k, "text": "".join(part.matches), "lengths": [len(m) for m in part.matches],
        "sizes": [-1 if x is None else len(x) for x in part.ids], "ids": list(chain.from_iterable(x or () for x in part.ids)),
    }


def _from_row(r: dict) -> Part:
    ends = list(accumulate(r["lengths"], initial=0))
    matches = [r["text"][a:b] for a, b in zip(ends, ends[1:], strict=False)]
    ids, at = [], 0
    for n in r["sizes"]:
        ids.append(None if n < 0 else r["ids"][at : at + n])
        at += max(n, 0)
    return Part(matches, ids)


def _giant(chunks: DataFrame, make: Callable[[], ByteEncoder], fan: int) -> DataFrame:
    """(row, ids) of the giant texts whose chunks these are."""
    spark = chunks.sparkSession
    last, many = chunks.agg(F.max("k"), F.count("*")).first()
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_as_row(r["row"], r["k"], encoder.part(r["text"]))], _PARTS)

    def join(table: pa.Table) -> pa.Table:
        encoder = make()
        rows = sorted(table.select(_PARTS.names).to_pylist(), key=lambda r: r["k"])

        def halves(first: int, after: int) -> Part:
            if after - first == 1:
                return _from_row(rows[first])
            middle = (first + after) // 2
            return encoder.joined(halves(first, middle), halves(middle, after))

        return pa.Table.from_pylist([_as_row(rows[0]["row"], rows[0]["k"] // fan, halves(0, len(rows)))], _PARTS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "ids": encoder.ids(_from_row(r))}], _IDS)

    # A chunk is seconds of work, so each task gets few, however small the table is.
    dealt = chunks.repartition(min(many, slots), "row", "k")
    parts = written(dealt.mapInArrow(leaves, from_arrow_schema(_PARTS)), "parts")
    while last > 0:
        groups = parts.withColumn("g", F.floor(F.col("k") / fan)).groupBy("row", "g")
        parts = written(groups.applyInArrow(lambda t: join(t), from_arrow_schema(_PARTS)), "parts")
        last //= fan
    return parts.mapInArrow(finish, from_arrow_schema(_IDS))


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", giant: int = GIANT, leaf: int = LEAF, fan: int = FAN
) -> DataFrame:
    """Add each text's ids; a column of that name is replaced, all others stay.

    ``ranks`` is a rank file's contents, ``pattern`` what cuts texts before merges, which must not look
    back. No special tokens: their spellings are text. Null and empty texts have no ids. Ids are the
    same whatever ``giant``, ``leaf`` and ``fan`` are. A row with all its ids is held by one task.
    """
    columns = without(docs.columns, [ids_col])
    kept = docs.select(*(f"`{c}`" for c in columns))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    long = F.length(F.col(f"`{text_col}`")) > giant
    names = schema.names

    def make() -> ByteEncoder:
        return ByteEncoder(read_ranks(ranks), pattern, leaf)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            texts = tx.column(batch, text_col)
            for first, last in tx.slices(texts):
                found = [encoder(t) for t in texts.slice(first, last - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(found, pa.list_(pa.int32()))], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for k in range(math.ceil(len(r["text"]) / giant)):
                    yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": k, "text": r["text"][k * giant : (k + 1) * giant]}], _CHUNKS)

    done = map_arrow(kept.where(~long | long.isNull()), small, schema)
    giants = kept.where(long)
    if giants.isEmpty():
        return done
    row = unused_name("_row", columns)
    giants = written(giants.withColumn(row, F.monotonically_increasing_id()), "giants")
    chunks = giants.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    chunks = written(map_arrow(chunks, cut, from_arrow_schema(_CHUNKS)), "chunks")
    ids = _giant(chunks, make, fan).select(F.col("row").alias(row), F.col("ids").alias(unused_name("_ids", columns)))
    joined = giants.join(ids, row).select(*(f"`{c}`" for c in columns), F.col(unused_name("_ids", columns)).alias(ids_col))
    return done.unionByName(joined)


def decode(rows: DataFrame, ranks: bytes, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for, concatenated up a tree; null ids give null, no ids no bytes.

    A column of that name is replaced.
    """
    columns = without(rows.columns, [bytes_col])
    kept = rows.select(*(f"`{c}`" for c in columns))
    schema = T.StructType([*kept.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    place = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: t for t, n in read_ranks(ranks).items()}
        tokens = [known.get(n, b"") for n in range(max(known, default=-1) + 1)]
        starts = np.cumsum([0, *map(len, tokens)], dtype=np.int64)
        store = np.frombuffer(b"".join(tokens), np.uint8)

        def span(ids: np.ndarray) -> bytes:
            if len(ids) <= LEAF:
                return tx.gathered(store, starts, ids)[0].tobytes()
            middle = len(ids) // 2
            return span(ids[:middle]) + span(ids[middle:])

        for batch in batches:
            for at in range(0, len(batch), 64):
                few = batch.slice(at, 64)
                lists = few.column(place)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                found = [
                    span(flat[a:b]) if valid else None
                    for a, b, valid in zip((0, *ends[:-1]), ends, lists.is_valid().to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(found, pa.binary())], names=schema.names)

    return map_arrow(kept, run, schema)
