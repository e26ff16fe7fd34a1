"""Token files with directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those that have one, and so on; a bitmap per level
says which ids go on, and counts of its ones per 512 bits (a rank directory) tell where.
Any id is thus read from a few bytes, without decoding those before it.

A segment is one row: the levels, bitmaps and rank directories of many documents' ids, and
a directory of the documents. Segments are Parquet rows, written by Spark, so that they can
lie in any store that Spark writes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow

LEVELS = 4
RANK_BITS = 512
#: Ids of a segment; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 17
#: Bytes of text encoded at once.
SLICE = 1 << 18

SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("first", T.LongType()),  # ids of the part before this segment
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_sizes", T.ArrayType(T.LongType())),
        T.StructField("levels", T.ArrayType(T.BinaryType())),
        T.StructField("bitmaps", T.ArrayType(T.BinaryType())),
        T.StructField("ranks", T.ArrayType(T.BinaryType())),
    ]
)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while len(levels) < LEVELS and (len(rest) or not levels):
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        bitmaps.append(bits.tobytes())
        per_block = np.add.reduceat(on.astype(np.int64), np.arange(0, len(on), RANK_BITS)) if len(on) else np.zeros(0, np.int64)
        ranks.append(np.concatenate(([0], np.cumsum(per_block)))[:-1].astype("<u4").tobytes() if len(on) else b"")
        rest = rest[on] >> 8
    return levels, bitmaps, ranks


def unpack(n: int, levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids, going = np.zeros(n, np.uint32), np.arange(n)
    for k, (level, bitmap) in enumerate(zip(levels, bitmaps, strict=True)):
        ids[going] |= np.frombuffer(level, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(going), bitorder="little").astype(bool)
        going = going[on]
    return ids


def id_at(place: int, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> int:
    """One id of a segment, from a few bytes per level."""
    value = 0
    for k, (level, bitmap, rank) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        value |= level[place] << (8 * k)
        if not bitmap[place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        ahead = int.from_bytes(bitmap[block * RANK_BITS // 8 : (place >> 3) + 1], "little")
        ahead &= (1 << (place - block * RANK_BITS)) - 1
        place = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + ahead.bit_count()
    return value


def write_segments(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]],
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode all texts and write segments in ascending order of ``id_col``.

    ``make_encoder`` is called once per task and turns texts into arrays of ids. Null texts
    are empty ones. Null ids come first; rows with equal ids are ordered by their texts, so
    the order is the same however often a task is run. Parts are ranges of ids, and a range
    of rows of one id is split by text.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    narrow = narrow.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = make_encoder(), TaskContext.get().partitionId()
        number, first, held, names = 0, 0, [], []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            levels, bitmaps, ranks = pack(ids)
            row = {
                "part": part, "segment": number, "first": first, "n_ids": len(ids), "doc_ids": names,
                "doc_sizes": [len(x) for x in held], "levels": levels, "bitmaps": bitmaps, "ranks": ranks,
            }
            return pa.RecordBatch.from_pylist([row], _ARROW)

        size = 0
        for batch in batches:
            for at, after in tx.slices(batch.column(1), SLICE):
                few = batch.slice(at, after - at)
                for name, ids in zip(few.column(0).to_pylist(), encode(few.column(1).to_pylist()), strict=True):
                    if held and size + len(ids) > segment_ids:
                        yield segment()
                        number, first, held, names, size = number + 1, first + size, [], [], 0
                    held.append(ids)
                    names.append(name)
                    size += len(ids)
        if held:
            yield segment()

    map_arrow(narrow, run, SEGMENTS).write.parquet(path)


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())),
        ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ]
)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def documents_of(segments: DataFrame) -> DataFrame:
    """One row per document of written segments: id, ``start`` (ids before it), n_tokens, ids_crc32.

    A part's offset is the ids of all parts before it; there is a row per part, which bounds the broadcast.
    """
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("ids")).collect()  # a row per part
    offsets, total = [], 0
    for row in sorted(sizes):
        offsets.append((row["part"], total))
        total += row["ids"]
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + [T.StructField("part", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = unpack(row["n_ids"], row["levels"], row["bitmaps"]).astype("<u4")
                ends = np.cumsum(row["doc_sizes"], dtype=np.int64)
                starts = ends - np.array(row["doc_sizes"], np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"]), pa.array(row["doc_sizes"], pa.int64()),
                        pa.array(crcs, pa.int64()), pa.array([row["part"]] * len(crcs), pa.int32()),
                    ],
                    names=schema.names,
                )

    docs = segments.select("part", "first", "n_ids", "doc_ids", "doc_sizes", "levels", "bitmaps").mapInArrow(run, schema)
    spark = segments.sparkSession
    parts = spark.createDataFrame(offsets, "part int, offset long")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
