"""SentencePiece encoding by Viterbi, with a max-plus scan over giant documents.

A text is encoded as the pieces of the largest total score that spell it. Ordinary texts
fall into parts that no piece crosses, such as words, which are searched once and remembered. A giant document is cut into chunks of equal length. What a chunk does to
the scores of the states at its border (how far the last piece reaches across) is a matrix;
products of such matrices, with max for sum and sum for product, are associative and are
combined group by group. With the scores before it known, each chunk says from which
border state each state at its end comes; these maps are combined in the same way from the
right. Then every chunk is traced back on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, unused_name, without
from gapline.sources.scratch import written

SPACE = "▁"
#: Stands for a text's own U+2581, which must not come back as a space. No valid text holds it.
OWN_SPACE = "\udc81"
#: Characters of a chunk; matrices combined by one task.
CHUNK, GROUP = 1 << 16, 64
#: Chunks of a task, where there are enough of them for all tasks.
SHARED = 4
#: Stands between texts.
BETWEEN = "\udc82"
#: Parts that a task remembers before it starts over; characters encoded at once.
REMEMBERED, CHARS = 300_000, 1 << 18
UNKNOWN_PENALTY = 10.0
NEVER = -np.inf


class Vocabulary:
    """Pieces with scores, and bytes for characters that no piece spells."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = proto.ModelProto()
        read.ParseFromString(model)
        kinds = proto.ModelProto.SentencePiece
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.spelled: list[bytes] = []
        for n, p in enumerate(read.pieces):
            self.spelled.append(b"")
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.spelled[n] = n, bytes([value])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.pieces[p.piece] = (n, float(p.score))
                self.spelled[n] = p.piece.replace(SPACE, " ").encode()
        #: All that a piece begins with; with id and score, if it is a piece itself.
        self.prefixes = {p[:k]: self.pieces.get(p[:k]) for p in self.pieces for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Which characters ever follow each other within a piece: between all others a text can be cut.
        inner = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.follows = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in self.pieces:
            codes = self.kind[[ord(c) for c in p]]
            self.follows[codes[:-1], codes[1:]] = True
        sizes = np.array([len(b) for b in self.spelled], np.int64)
        self.spelled_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)

    def spelling(self, text: str) -> str:
        """The text as pieces spell it: spaces marked, one put in front."""
        return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""

    def starting(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of pieces at a place, the shortest first; id -1 for a character of bytes."""
        found, prefixes = [], self.prefixes
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = prefixes.get(text[at:end], NEVER)
            if piece is NEVER:
                break
            if piece is not None:
                found.append((end, *piece))
        if not found or found[0][0] > at + 1:
            found.append((at + 1, -1, self.unknown))
        return found

    def ids_of(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        ids: list[int] = []
        for start, end, n in path:
            if n >= 0:
                ids.append(n)
            else:
                ids.extend(self.byte_ids[b] for b in text[start:end].replace(OWN_SPACE, SPACE).encode())
        return ids

    def forward(self, text: str, size: int, scores: list[float]) -> tuple[list[float], list[tuple[int, int]]]:
        """Best score at each place and (start, id) of the piece that ends there (-1: it began before).

        ``scores`` holds those of the first places, ``size`` is where the chunk ends; pieces may reach
        beyond. Of equal scores the piece that begins first wins.
        """
        places = max(size + self.longest, len(scores) + 1)
        best, back = [*scores, *([NEVER] * (places - len(scores)))], [(-1, -1)] * places
        for at in range(size):
            own = best[at]
            if own > NEVER:
                for end, n, score in self.starting(text, at):
                    if own + score > best[end]:
                        best[end], back[end] = own + score, (at, n)
        return best, back

    def traced(self, back: list[tuple[int, int]], end: int) -> tuple[list[tuple[int, int, int]], int]:
        """Pieces (start, end, id) that lead to a place, and the place where the first begins."""
        path = []
        while end > 0 and back[end][0] >= 0:
            start, n = back[end]
            path.append((start, end, n))
            end = start
        return path[::-1], end

    def encoded(self, text: str) -> list[int]:
        """Ids of a spelled text, from one end to the other: ``forward`` and ``traced`` in one, for short texts."""
        size, longest, get, unknown = len(text), self.longest, self.prefixes.get, self.unknown
        best, back = [0.0] + [NEVER] * size, [(0, 0)] * (size + 1)
        for at in range(size):
            own, single = best[at], False
            for end in range(at + 1, min(at + longest, size) + 1):
                piece = get(text[at:end], NEVER)
                if piece is NEVER:
                    break
                if piece is not None:
                    single |= end == at + 1
                    score = own + piece[1]
                    if score > best[end]:
                        best[end], back[end] = score, (at, piece[0])
            if not single and own + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = own + unknown, (at, -1)
        path, end = [], size
        while end:
            start, n = back[end]
            path.append((start, end, n))
            end = start
        return self.ids_of(text, path[::-1])

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best score from each border state before the chunk to each behind it."""
        states = self.longest
        best = np.full((size + states, states), NEVER)
        best[np.arange(min(states, len(best))), np.arange(min(states, len(best)))] = 0.0
        at, shift = 0, None
        while at < size:
            if at >= states and at % 32 == 0 and (shift := _shift(best[at : at + states])) is not None:
                break
            if (best[at] > NEVER).any():
                for end, _, score in self.starting(text, at):
                    np.maximum(best[end], best[at] + score, out=best[end])
            at += 1
        if shift is None:
            return best[size : size + states].T.copy()
        base, alive = shift
        scores, _ = self.forward(text[at:], size - at, best[at : at + states, base].tolist())
        out = np.array(scores[size - at : size - at + states])
        return np.where(np.isneginf(alive)[:, None], NEVER, alive[:, None] + out[None, :])

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of ids that stand end to end, so many per text."""
        data, sizes = tx.gathered(self.spelled_bytes, self.spelled_starts, ids)
        ends = np.cumsum(np.concatenate(([0], sizes)))[np.cumsum(counts)]
        offsets = np.concatenate(([0], ends))
        spaces = offsets[:-1][counts > 0]  # the one put in front of each text
        kept = np.ones(len(data), bool)
        kept[spaces] = False
        shift = np.concatenate(([0], np.cumsum(counts > 0)))
        return pa.StringArray.from_buffers(
            len(counts), pa.py_buffer((offsets - shift).astype(np.int32).tobytes()), pa.py_buffer(data[kept].tobytes())
        )


def _shift(window: np.ndarray) -> tuple[int, np.ndarray] | None:
    """If all states' scores differ by a constant: a state to stand for all, and the constants."""
    alive = (window > NEVER).any(0)
    if not alive.any():
        return None
    base = int(np.flatnonzero(alive)[0])
    some = window[:, base] > NEVER
    if ((window > NEVER) != (some[:, None] & alive[None, :])).any():
        return None
    differ = window[some] - window[some][:, [base]]
    if (differ[:, alive] != differ[:1, alive]).any():
        return None
    return base, np.where(alive, differ[0], NEVER)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[..., :, None] + b[None, :, :]).max(-2) if a.ndim > 1 else (a[:, None] + b).max(0)


class Encoder:
    """Encodes ordinary texts, many at a time.

    Texts are cut between characters that never follow each other in a piece. The parts are
    known by 64-bit hashes, and each is searched just once as long as it is remembered.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.hasher = vocabulary, tx.Hasher()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has."""
        v = self.vocabulary
        spelled = [v.spelling(t) for t in texts]
        joined = BETWEEN.join(["", *spelled, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = v.kind[codes]
        cut = np.flatnonzero(~v.follows[kind[:-1], kind[1:]]) + 1
        starts = np.concatenate(([0], cut))
        ends = np.concatenate((cut, [len(codes)]))
        real = codes[starts] != ord(BETWEEN)
        texts_of = np.cumsum(~real)[real] - 1
        starts, ends = starts[real], ends[real]
        hashes = self.hasher.of_values(tx.mixed(codes.astype(np.uint64) + np.uint64(1)), starts, ends)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        numbers, new = np.empty(len(distinct), np.int64), []
        for k, h in enumerate(distinct.tolist()):
            n = self.known.get(h)
            if n is None:
                n = self.known[h] = len(self.known)
                new.append(v.encoded(joined[starts[first[k]] : ends[first[k]]]))
            numbers[k] = n
        if new:
            sizes = np.array([len(x) for x in new], np.int64)
            self.ids = np.concatenate((self.ids, np.array([n for x in new for n in x], np.int32)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        ids, sizes = tx.gathered(self.ids, self.starts, numbers[at])
        return ids, np.bincount(texts_of, weights=sizes, minlength=len(texts)).astype(np.int64)


_CHUNKS = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("ahead", pa.string())])
_MATRICES = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("matrix", pa.binary())])
_VECTORS = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("vector", pa.binary())])


def _square(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.float64)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def vectors_before(matrices: DataFrame, last: int, group: int = GROUP) -> DataFrame:
    """(row, k, vector): scores of the border states before each chunk, starting in state 0.

    ``matrices`` has one per chunk k of a row, ``last`` is the largest k. No task holds more than
    ``group`` matrices of a row: their products are scanned first, then each group on from there.
    """

    def through(rows: list[dict], vector: np.ndarray | None) -> Iterator[dict]:
        for r in sorted(rows, key=lambda r: r["k"]):
            matrix = _square(r["matrix"])
            if vector is None:
                vector = np.full(len(matrix), NEVER)
                vector[0] = 0.0
            yield {"row": r["row"], "k": r["k"], "vector": vector.tobytes()}
            vector = product(vector, matrix)

    if last < group:
        return matrices.groupBy("row").applyInArrow(
            lambda t: pa.Table.from_pylist(list(through(t.to_pylist(), None)), _VECTORS), from_arrow_schema(_VECTORS)
        )

    def combined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        total = _square(rows[0]["matrix"])
        for r in rows[1:]:
            total = product(total, _square(r["matrix"]))
        return pa.Table.from_pylist([{"row": rows[0]["row"], "k": rows[0]["k"] // group, "matrix": total.tobytes()}], _MATRICES)

    def spread(members: pa.Table, before: pa.Table) -> pa.Table:
        start = np.frombuffer(before.column("vector")[0].as_py(), np.float64)
        return pa.Table.from_pylist(list(through(members.select(_MATRICES.names).to_pylist(), start)), _VECTORS)

    grouped = matrices.withColumn("g", F.floor(F.col("k") / group))
    products = grouped.groupBy("row", "g").applyInArrow(lambda t: combined(t), from_arrow_schema(_MATRICES))
    before = vectors_before(written(products, "products"), last // group, group)
    return grouped.groupBy("row", "g").cogroup(before.withColumnRenamed("k", "g").groupBy("row", "g")).applyInArrow(spread, from_arrow_schema(_VECTORS))


def _giant(chunks: DataFrame, model: bytes, group: int) -> DataFrame:
    """(row, k, ids) of the chunks of giant documents."""
    last, many = chunks.agg(F.max("k"), F.count("*")).first()
    spark = chunks.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(rows: DataFrame) -> DataFrame:
        """Deal chunks out, however small the table that they are read from; a few share the cost of loading the pieces."""
        return rows.repartition(min(-(-many // SHARED), slots), "row", "k")

    def mapped(run: Callable, schema: pa.Schema) -> Callable:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(model)
            for batch in batches:
                for r in batch.to_pylist():
                    yield pa.RecordBatch.from_pylist([run(vocabulary, r)], schema)

        return over

    def matrix(v: Vocabulary, r: dict) -> dict:
        text = _own(r["text"])
        return {"row": r["row"], "k": r["k"], "matrix": v.matrix(text + _own(r["ahead"]), len(text)).tobytes()}

    def origins(v: Vocabulary, r: dict) -> dict:
        """Which border state before the chunk each one behind it comes from, as a matrix to go left by."""
        text = _own(r["text"])
        _, back = v.forward(text + _own(r["ahead"]), len(text), np.frombuffer(r["vector"], np.float64).tolist())
        out = np.full((v.longest, v.longest), NEVER)
        for state in range(v.longest):
            if back[len(text) + state][0] >= 0:
                out[state, v.traced(back, len(text) + state)[1]] = 0.0
        return {"row": r["row"], "k": r["count"] - 1 - r["k"], "matrix": out.tobytes()}

    def ids(v: Vocabulary, r: dict) -> dict:
        text = _own(r["text"])
        spelled = text + _own(r["ahead"])
        _, back = v.forward(spelled, len(text), np.frombuffer(r["vector"], np.float64).tolist())
        state = int(np.flatnonzero(np.frombuffer(r["exit"], np.float64) == 0.0)[0])
        return {"row": r["row"], "k": r["k"], "ids": v.ids_of(spelled, v.traced(back, len(text) + state)[0])}

    made = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("ids", pa.list_(pa.int32()))])
    matrices = written(dealt(chunks).mapInArrow(mapped(matrix, _MATRICES), from_arrow_schema(_MATRICES)), "matrices")
    entered = chunks.join(written(vectors_before(matrices, last, group), "vectors"), ["row", "k"])
    counts = chunks.groupBy("row").agg(F.count("*").alias("count"))
    entered = written(entered.join(counts, "row"), "entered")
    back = written(dealt(entered).mapInArrow(mapped(origins, _MATRICES), from_arrow_schema(_MATRICES)), "origins")
    exits = vectors_before(back, last, group).select("row", F.col("k").alias("left"), F.col("vector").alias("exit"))
    known = entered.withColumn("left", F.col("count") - 1 - F.col("k")).join(exits, ["row", "left"])
    return dealt(known).mapInArrow(mapped(ids, made), from_arrow_schema(made))


def _own(text: str) -> str:
    return text.replace("\x01\x01", OWN_SPACE).replace("\x01\x02", "\x01")


def _plain(text: str) -> str:
    """A spelled text that can be stored: Arrow takes no lone surrogates."""
    return text.replace("\x01", "\x01\x02").replace(OWN_SPACE, "\x01\x01")


def encode(
    docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, group: int = GROUP
) -> DataFrame:
    """Add the ids of each text's best pieces; a column of that name is replaced.

    Null and empty texts have none. Characters that no piece spells become bytes, and so does
    U+2581, the mark for spaces: every text is decoded as it was. Of equally good ways to spell a
    text the one whose pieces begin first, from the end backwards, is taken, whatever the chunks.
    Texts of at most ``chunk`` characters are encoded where they are; longer ones are cut (``chunk`` must be
    no less than the longest piece) and their chunks are spread over all tasks.
    """
    columns = without(docs.columns, [ids_col])
    kept = docs.select(*(f"`{c}`" for c in columns))
    ids_field = T.StructField(ids_col, T.ArrayType(T.IntegerType()))
    schema = T.StructType([*kept.schema.fields, ids_field])
    names, place = schema.names, columns.index(text_col)
    long = F.length(F.col(f"`{text_col}`")) > chunk

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(model))
        for batch in batches:
            texts = tx.column(batch, text_col)
            for first, last in tx.slices(texts, CHARS):
                ids, counts = encoder(texts.slice(first, last - first).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, found], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = Vocabulary(model), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                text = vocabulary.spelling(one.column(place)[0].as_py())
                starts = range(0, max(1, len(text) // chunk) * chunk, chunk)  # the last chunk is the longest
                ends = [*starts[1:], len(text)]
                for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    row = [number, k, _plain(text[a:b]), _plain(text[b : b + vocabulary.longest])]
                    own = [pa.array([v], f.type) for v, f in zip(row, _CHUNKS, strict=True)]
                    rest = [pa.nulls(1, x.type) if k else x for x in one.columns]  # with the first chunk only
                    yield pa.RecordBatch.from_arrays([*own, *rest], names=[*own_names, *plain_names])
                number += 1

    done = map_arrow(kept.where(~long | long.isNull()), small, schema)
    giant = kept.where(long)
    if giant.isEmpty():
        return done
    own_names = [unused_name(f"_{f.name}", columns) for f in _CHUNKS]
    plain_names = [f"c{k}" for k in range(len(columns))]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    fields = [T.StructField(n, t) for n, t in zip(own_names, kinds, strict=True)]
    fields += [T.StructField(n, f.dataType) for n, f in zip(plain_names, kept.schema.fields, strict=True)]
    chunks = written(map_arrow(giant, cut, T.StructType(fields)), "chunks")
    heads = chunks.where(F.col(own_names[1]) == 0).select(F.col(own_names[0]).alias("row"), F.struct(*plain_names).alias("head"))
    chunks = chunks.select(*(F.col(a).alias(f.name) for a, f in zip(own_names, _CHUNKS, strict=True)))
    chunks = written(chunks, "chunks")
    parts = written(_giant(chunks, model, group), "chunk-ids")
    whole = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias(ids_col))
    joined = heads.join(whole, "row").select(
        *(F.col(f"head.{p}").alias(c) for p, c in zip(plain_names, columns, strict=True)), F.col(ids_col)
    )
    return done.unionByName(joined)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that ids spell; null ids give null. A column of that name is replaced."""
    columns = without(rows.columns, [text_col])
    kept = rows.select(*(f"`{c}`" for c in columns))
    schema = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])
    place = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                few = batch.slice(at, 256)
                lists = few.column(place)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = vocabulary.decoded(lists.flatten().to_numpy(zero_copy_only=False), counts)
                if lists.null_count:
                    texts = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*few.columns, texts], names=schema.names)

    return map_arrow(kept, run, schema)

