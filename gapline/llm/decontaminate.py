"""Benchmark decontamination by a suffix automaton of the test items.

All test items, as sequences of words, go into one automaton. A text's words are streamed
through it; it tells the longest match that ends at each word. Wherever that is as long as
a window (or a whole shorter item ends), the window's words are hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm import text as tx
from gapline.llm.frames import map_arrow, unused_name, without

WINDOW = 10
#: Words of one automaton. More items are split into several, each of which sees all texts.
BLOCK_WORDS = 100_000


class Automaton:
    """Suffix automaton of several sequences of word numbers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ends = []
        for _, words in items:
            last = 0
            for word in words:
                last = self._extended(last, word)
            ends.append(last)
        n = len(self.length)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for (name, words), end in zip(items, ends, strict=True):
            if len(words) < window:
                self.whole[end].append((len(words), name))
            at, state = 0, 0
            for word in words:  # states of the item's prefixes
                state, at = self.next[state][word], at + 1
                if at >= window:
                    self.items[state].add(name)
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):
            if self.length[self.link[v]] >= window:
                self.items[self.link[v]] |= self.items[v]
        # The state of a match's last `window` words, and the next state up that ends a whole short item.
        self.windowed, self.marked = list(range(n)), [0] * n
        for v in order:
            up = self.link[v]
            if self.length[up] >= window:
                self.windowed[v] = self.windowed[up]
            self.marked[v] = v if self.whole[v] else self.marked[up]

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _state(self, after: dict[int, int], length: int, link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of every window and whole item, by its end."""
        state, size = 0, 0
        for at, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size >= self.window:
                yield at - self.window, at, self.items[self.windowed[state]]
            up = self.marked[state]
            while up:
                found = {name for length, name in self.whole[up] if length <= size}
                if found:
                    length = self.whole[up][0][0]
                    yield at - length, at, found
                up = self.marked[self.link[up]]


class Matcher:
    """Finds the hits of one block of items in many texts."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.hasher = tx.Hasher()
        texts = pa.array([t for _, t in items], pa.string())
        w = tx.words_of(texts, tx.ALPHANUMERIC, self.hasher)
        self.vocabulary = np.unique(w.hashes)
        numbers = np.searchsorted(self.vocabulary, w.hashes)
        parts = np.split(numbers, np.cumsum(w.counts)[:-1])[: len(items)]
        named = [(name, part.tolist()) for (name, _), part in zip(items, parts, strict=True) if len(part)]
        self.least = min((min(len(p), window) for _, p in named), default=0)
        together = w.texts[1:] == w.texts[:-1]
        self.pairs = np.unique((numbers[:-1] * len(self.vocabulary) + numbers[1:])[together])
        self.automaton = Automaton(named, window)

    def _runs(self, numbers: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words whose neighbours are neighbours in an item too: no match is longer."""
        if self.least == 1:
            known = numbers >= 0
            link = known[1:] & known[:-1] & (rows[1:] == rows[:-1])
        else:
            code = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            link = (self.pairs[near] == code) & (numbers[1:] >= 0) & (numbers[:-1] >= 0) & (rows[1:] == rows[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], link, [False])).astype(np.int8)))
        for first, last in zip(edges[::2], edges[1::2], strict=True):
            if last - first + 1 >= self.least:
                yield int(first), int(last) + 1
        if self.least == 1:
            linked = np.zeros(len(numbers), bool)
            linked[:-1] |= link
            linked[1:] |= link
            for at in np.flatnonzero(known & ~linked):
                yield int(at), int(at) + 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Words per text; by text with hits, spans of words (joined where they overlap) and items."""
        w = tx.words_of(texts, tx.ALPHANUMERIC, self.hasher)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.least and len(w.hashes):
            near = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
            numbers = np.where(self.vocabulary[near] == w.hashes, near, -1)
            begins = np.concatenate(([0], np.cumsum(w.counts)))
            for first, last in self._runs(numbers, w.texts):
                row = int(w.texts[first])
                for low, high, names in self.automaton.matches(numbers[first:last].tolist()):
                    low, high = low + first - int(begins[row]), high + first - int(begins[row])
                    spans.setdefault(row, []).append((low, high))
                    items.setdefault(row, set()).update(names)
        return w.counts, {row: _joined(s) for row, s in spans.items()}, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    block, words = [], 0
    for row in rows.where("id is not null and text is not null").toLocalIterator():
        block.append((row["id"], row["text"]))
        words += len(row["text"]) // 2 + 1  # at least its words
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add ``n_words``, ``spans`` (of hit words, counted from 0) and ``items`` (ids as strings, sorted).

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of all characters from
    U+0080 on. A hit word is inside an occurrence of ``window`` consecutive words of an item, or
    of a whole shorter one. Items without an id or without words match nothing, nor do null and
    empty texts. Columns of the three names are replaced; rows stay as often as they occur. Items are the
    stated query set: they come to the driver block by block, and each block's automaton sees all
    documents in one pass that shuffles nothing.
    """
    added = ("n_words", "spans", "items")
    docs = docs.select(*(f"`{c}`" for c in without(docs.columns, added)))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *fields])

    def pass_over(block: list[tuple[str, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, window)
            for batch in batches:
                texts = tx.column(batch, text_col)
                for first, last in tx.slices(texts):
                    part, n = batch.slice(first, last - first), last - first
                    counts, spans, names = matcher(texts.slice(first, n))
                    old = {c: part.column(part.schema.get_field_index(c)) for c in added[1:] if c in part.schema.names}
                    if old:  # of the blocks before
                        for row in range(n):
                            before = [(x["first"], x["after"]) for x in old["spans"][row].as_py()]
                            if before:
                                spans[row] = _joined(before + spans.get(row, []))
                                names[row] = {*old["items"][row].as_py(), *names.get(row, ())}
                    yield tx.with_columns(
                        part,
                        n_words=pa.array(counts, pa.int64()),
                        spans=pa.array([[{"first": a, "after": b} for a, b in spans.get(k, ())] for k in range(n)], _ARROW_SPANS),
                        items=pa.array([sorted(names.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                    )

        return run

    blocks = 0
    for block in _blocks(items, item_id, item_text, block_words):
        docs, blocks = map_arrow(docs, pass_over(block), schema), blocks + 1
    return docs if blocks else map_arrow(docs, pass_over([]), schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    max_span: int = WINDOW - 1,
    max_coverage: float = 0.5,
    **options,
) -> DataFrame:
    """Documents without the passages they share with test items.

    Spans of more than ``max_span`` hit words are cut out of the text. A document of whose words
    more than ``max_coverage`` are hits is left out; all others keep their columns. See ``find_overlaps``.
    """
    spans, words, names = (unused_name(c, docs.columns) for c in ("_spans", "_n_words", "_items"))
    columns = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(columns))))  # no clash with the added names
    found = find_overlaps(plain, items, f"c{columns.index(text_col)}", **options)
    found = found.toDF(*columns, words, spans, names)
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    found = found.where(covered <= F.lit(max_coverage) * F.col(words)).drop(words, names)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher()
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            old, at = batch.column(place), batch.column(batch.schema.get_field_index(spans))
            new = {}
            for row in np.flatnonzero(np.asarray(pa.compute.list_value_length(at)) > 0).tolist():
                long = [(s["first"], s["after"]) for s in at[row].as_py() if s["after"] - s["first"] > max_span]
                if long:
                    w = tx.words_of(old.slice(row, 1), tx.ALPHANUMERIC, hasher)
                    text, left, pieces = old[row].as_py().encode(), 0, []
                    for first, after in long:
                        pieces.append(text[left : w.starts[first]])
                        left = w.ends[after - 1]
                    new[row] = b"".join([*pieces, text[left:]]).decode()
            texts = pa.array([new.get(k, v) for k, v in enumerate(old.to_pylist())], old.type) if new else old
            arrays = [texts if k == place else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_arrow(found, run, schema)
