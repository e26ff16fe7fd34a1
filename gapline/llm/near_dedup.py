"""Near-duplicates by a multi-index join of MinHash signatures, confirmed on full sets.

A text is the set of its 5-word shingles. Its signature has 64 slots of 14 bits, each of
the least shingle under one hash; slots of two sets differ with about one minus their
similarity. Four slots make one of 16 chunks. Signatures that differ in at most 31 slots
have, by pigeonhole, a chunk with at most one error; so each chunk is indexed four times,
with one slot left out, and all pairs within that distance meet. At similarity 0.75 a pair
is farther apart about once in 50,000 times.

A set also has a bitmap of 2048 bits, on which its shingles are hashed. Every bit in which two
bitmaps differ stands for a shingle that just one of the sets has, and linked sets have
at most a seventh of their joint size of these. That rules pairs out without an error.

Pairs that meet are not all made. First every text is compared with the hubs of its keys: the
smallest id of each. Links that hold make components; only texts that share a chunk key with
a text of another component are then compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, unused_name
from gapline.sources.scratch import written

SHINGLE = 5
#: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
SLOTS, BITS, PER_CHUNK = 64, 14, 4
LANE = BITS + 1
CHUNKS = SLOTS // PER_CHUNK
#: Farthest signatures that pigeonhole makes meet.
DISTANCE = 2 * CHUNKS - 1
BITMAP_BITS = 2048
WORDS = BITMAP_BITS // 64

_LOWS = sum(((1 << BITS) - 1) << (LANE * k) for k in range(PER_CHUNK))
_TOPS = sum(1 << (LANE * k + BITS) for k in range(PER_CHUNK))


def shingles(texts: pa.Array, hasher: tx.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes and texts, in the texts' order.

    A text of fewer than five words has one, of all its words; one without words has none.
    """
    w = tx.words_of(texts, tx.SPACED, hasher)
    hashes, whole = tx.windows(w.hashes, w.texts, SHINGLE)
    places = np.flatnonzero(whole)
    hashes, rows = hashes[places], w.texts[places]
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(few):
        begins = np.cumsum(w.counts) - w.counts
        extra = []
        for row in few.tolist():
            value = np.array([w.counts[row]], np.uint64)
            for h in w.hashes[begins[row] : begins[row] + w.counts[row]]:
                value = tx.mixed(value * tx.MULTIPLIER + h)
            extra.append(value)
        hashes, rows = np.concatenate((hashes, *extra)), np.concatenate((rows, few))
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    first = np.unique(salted(hashes, rows), return_index=True)[1]
    first.sort()
    return hashes[first], rows[first]


def salted(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return tx.mixed(hashes + tx.mixed(rows.astype(np.uint64) + np.uint64(1)))


def _signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunks of packed slots for each run of hashes."""
    odd = tx.mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * tx.MULTIPLIER) | np.uint64(1)
    out = np.zeros((len(starts), CHUNKS), np.int64)
    held = np.empty_like(hashes)
    for k in range(SLOTS):
        np.multiply(hashes, odd[k], out=held)
        least = tx.mixed(np.minimum.reduceat(held, starts)) & np.uint64((1 << BITS) - 1)
        out[:, k // PER_CHUNK] |= least.astype(np.int64) << (LANE * (k % PER_CHUNK))
    return out


def _bitmaps(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A bitmap of each of the rows 0, 1, ..., as 64-bit numbers."""
    bits = np.zeros((int(rows[-1]) + 1, BITMAP_BITS), bool)
    bits[rows, (tx.mixed(hashes) % np.uint64(BITMAP_BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size of its set, two hashes of the set, its signature's chunks and bitmap (null if empty)."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher()
        for batch in batches:
            texts = tx.column(batch)
            for first, last in tx.slices(texts):
                hashes, rows = shingles(texts.slice(first, last - first), hasher)
                sizes = np.bincount(rows, minlength=last - first)
                sums = [np.zeros(last - first, np.int64) for _ in range(2)]
                signed = [None] * (last - first)
                if len(hashes):
                    some, starts = np.unique(rows, return_index=True)
                    for k, s in enumerate(sums):
                        s[some] = np.add.reduceat(tx.mixed(hashes + np.uint64(k + 1)), starts).view(np.int64)
                    numbers = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(hashes))))
                    found = np.concatenate((_signatures(hashes, starts), _bitmaps(hashes, numbers)), axis=1)
                    for row, own in zip(some.tolist(), found, strict=True):
                        signed[row] = own
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()), *(pa.array(s) for s in sums), pa.array(signed, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "h1", "h2", "sig"],
                )

    return map_arrow(narrow, run, "doc_id long, n long, h1 long, h2 long, sig array<long>")


def _errors(a: Column, b: Column) -> Column:
    """Per chunk, the slots in which two signatures differ: a chunk's lanes are compared all at once."""
    chunks = (F.slice(x, 1, CHUNKS) for x in (a, b))
    return F.zip_with(*chunks, lambda x, y: F.bit_count((x.bitwiseXOR(y) + F.lit(_LOWS)).bitwiseAND(F.lit(_TOPS))))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def close(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sizes, signatures and bitmaps allow a link.

    Written with functions over arrays: spelled out per chunk, the condition of a join becomes a
    method too long for the JVM to compile.
    """
    words = (F.slice(x, CHUNKS + 1, WORDS) for x in (a, b))
    apart = _total(F.zip_with(*words, lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    sized = 100 * F.least(n_a, n_b) >= THRESHOLD * F.greatest(n_a, n_b)
    return sized & (_total(_errors(a, b)) <= DISTANCE) & ((100 + THRESHOLD) * apart <= (100 - THRESHOLD) * (n_a + n_b))


def _met_first(a: Column, b: Column, place: Column) -> Column:
    """Of the keys that two signatures share, whether the one at ``place`` is the first."""
    chunk = F.floor(place / PER_CHUNK).cast("int")
    meets = F.transform(_errors(a, b), lambda e: e <= 1)
    equal = F.get(a, chunk) == F.get(b, chunk)  # then all four of the chunk's keys are shared
    return ((place % PER_CHUNK == 0) | ~equal) & (F.array_position(meets, F.lit(True)) == chunk + 1)


def index_keys(sig: Column) -> Column:
    """Array of (place, key): a chunk without one of its slots, for all index chunks and slots."""
    keys = []
    for chunk in range(CHUNKS):
        for slot in range(PER_CHUNK):
            rest = ((1 << (LANE * PER_CHUNK)) - 1) & ~(((1 << LANE) - 1) << (LANE * slot))
            place = PER_CHUNK * chunk + slot
            key = F.xxhash64(F.lit(place), F.get(sig, F.lit(chunk)).bitwiseAND(F.lit(rest)))
            keys.append(F.struct(F.lit(place).cast("byte").alias("place"), key.alias("key")))
    return F.array(*keys)


def confirmed(pairs: DataFrame) -> DataFrame:
    """Of rows (a, b, text_a, text_b): a and b of those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher()
        for batch in batches:
            left, right = tx.column(batch, "text_a"), tx.column(batch, "text_b")
            for at in range(0, len(batch), 16):
                kept = _similar(left.slice(at, 16), right.slice(at, 16), hasher)
                yield batch.select(["a", "b"]).slice(at, 16).filter(pa.array(kept))

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _similar(left: pa.Array, right: pa.Array, hasher: tx.Hasher) -> np.ndarray:
    (ha, ra), (hb, rb) = shingles(left, hasher), shingles(right, hasher)
    n = len(left)
    keys_a, keys_b = salted(ha, ra), salted(hb, rb)
    order = np.argsort(keys_b)
    near = np.minimum(np.searchsorted(keys_b[order], keys_a), max(len(keys_b) - 1, 0))
    both = keys_b[order][near] == keys_a if len(keys_b) else np.zeros(len(keys_a), bool)
    shared = np.bincount(ra[both], minlength=n)
    union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - shared
    return (shared > 0) & (100 * shared >= THRESHOLD * union)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest node that is reachable.

    Large-star and small-star steps, each a sum by node and a join, until nothing changes. A node
    of many links is never one group: minima combine before the shuffle, and joins can be split.
    """
    edges = written(_ordered(links), "links")
    state = None
    for _ in range(64):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > of").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(_ordered(large), "links")
        small = _to_least(edges).select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.union(edges.groupBy("a").agg(F.min("b").alias("b")))
        edges = written(_ordered(small), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links, the larger node first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_least(edges: DataFrame) -> DataFrame:
    """Each link (of, b) with the least of ``of`` and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    return edges.select(F.col("a").alias("of"), "b").join(least.repartition("node"), F.col("of") == F.col("node")).drop("node")


def find_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents of a component are linked, directly or by others, by sets with
    100 * intersection >= 75 * union. ``component_id`` is the smallest id reachable. Null texts and
    texts without words have an empty set, linked with nothing. Rows without an id get no component
    and link nothing; rows that share an id are one document, and its texts share a component.
    """
    signed = written(signatures(docs, id_col, text_col), "signatures")
    sets = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    sets = written(sets, "sets")
    links = _links(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), sets)
    # A document stands for its set; texts that share an id join their sets.
    own = signed.where("n > 0 and doc_id is not null").join(sets.select("h1", "h2", "rep"), ["h1", "h2"])
    own = written(own.select("doc_id", "rep", "h1", "h2"), "copies")
    repeated = own.select("doc_id", "rep").distinct().groupBy("doc_id").agg(F.count("*").alias("k"), F.collect_set("rep").alias("reps")).where("k > 1")
    repeated = repeated.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b"))
    found = components(links.union(repeated))
    ids = own.select("doc_id", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left")
    ids = ids.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles")).join(ids.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id"))


def _links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different sets that give the components of all links."""
    keys = sets.select("rep", F.inline(index_keys(F.col("sig"))))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    hubs = written(hubs, "hubs")
    members = written(keys.join(hubs.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).drop("of"), "members")
    # The texts that share a key with any other, once each.
    involved = members.select("rep").distinct()
    texts = docs.join(involved, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    texts = written(texts, "texts")
    star = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    star = written(_close_pairs(star, sets), "star")
    first = written(_confirmed(star, texts), "links")
    found = components(first)
    # Keys that lead to more than one component, with their members' signatures.
    placed = members.select("key", "place", "rep").join(found, F.col("rep") == F.col("node"), "left")
    placed = written(placed.select("key", "place", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("last")).where("main <> last").drop("last")
    mixed = written(mixed, "mixed")
    open_ = placed.join(mixed.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).drop("of")
    open_ = written(open_.join(sets.select("rep", "sig", "n"), "rep"), "open")
    x = open_.where("component <> main").alias("x")
    y = open_.alias("y")
    met = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & _met_first(F.col("x.sig"), F.col("y.sig"), F.col("x.place"))
        & close(*map(F.col, ("x.sig", "y.sig", "x.n", "y.n")))
    )
    rest = written(x.join(y, met).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), "pairs")
    return first.union(_confirmed(rest, texts))


def _close_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures and sizes allow a link."""
    x = sets.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    y = sets.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    return pairs.join(x, "a").join(y, "b").where(close(*map(F.col, ("sig_a", "sig_b", "n_a", "n_b")))).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("rep").alias("ra"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rep").alias("rb"), F.col("text").alias("text_b"))
    joined = pairs.join(a, F.col("a") == F.col("ra")).join(b, F.col("b") == F.col("rb"))
    return confirmed(joined)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their component: those with the smallest id in it.

    Rows without an id are kept, and all rows of a kept id.
    """
    found, copy = find_components(docs, id_col, text_col), unused_name("_copy", docs.columns)
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
    copies = written(copies, "dropped")
    return docs.join(copies, F.col(f"`{id_col}`") == F.col(copy), "left_anti")
