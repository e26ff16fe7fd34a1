"""Language identification of whole, possibly mixed texts.

Words are scored per language by letter trigrams, learned from labelled documents. A
word's script decides which languages are candidates at all. Viterbi over the words, with
a penalty for every change of language, labels spans; the language of most letters is the
document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm.frames import map_arrow, without

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Log-probability that a change of language costs.
SWITCH = 12.0
#: Letters of a script make up at least this share in a language that uses it.
SCRIPT_SHARE = 0.01
#: Languages counted at once in a task, and characters handled at once.
HELD, CHARS = 64, 1 << 18

# First code point of ranges of Unicode, and the script that most letters in them have.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1900, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB10, "other"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x32000, "other"),
]
FIRSTS = np.array([r[0] for r in RANGES])
SCRIPTS = sorted({r[1] for r in RANGES})
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(r[1]) for r in RANGES])


class Letters(NamedTuple):
    """Letters of some texts: trigram bucket, script, and the word; words: first letter, text."""

    buckets: np.ndarray
    scripts: np.ndarray
    word_first: np.ndarray
    word_text: np.ndarray


class Reader:
    """Splits texts into words of letters."""

    def __init__(self) -> None:
        self.letter = np.array([chr(c).isalpha() for c in range(0x10000)])

    def is_letter(self, codes: np.ndarray) -> np.ndarray:
        out = self.letter[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]).tolist():
            out[codes == c] = chr(c).isalpha()
        return out

    def __call__(self, texts: list[str]) -> Letters:
        texts = [t.lower() for t in texts]
        joined = "\n".join(["", *texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        firsts = np.concatenate(([1], 1 + np.cumsum(sizes)[:-1])) if len(texts) else np.empty(0, np.int64)
        is_letter = self.is_letter(codes)
        bare = np.where(is_letter, codes, 0)
        at = np.flatnonzero(is_letter)
        mixed = (bare[at - 1] * 0x9E3779B1 + bare[at] * 0x85EBCA77 + bare[at + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
        buckets = (mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 12 & (BUCKETS - 1)
        scripts = SCRIPT_OF_RANGE[np.searchsorted(FIRSTS, codes[at], side="right") - 1]
        begins = np.flatnonzero(~is_letter[at - 1]) if len(at) else np.empty(0, np.int64)
        return Letters(buckets, scripts, begins, np.searchsorted(firsts, at[begins], side="right") - 1)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHARS`` characters, or one text."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > CHARS:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


class Model(NamedTuple):
    """Languages; log-probability per bucket and language; which scripts a language uses."""

    langs: list[str]
    scores: np.ndarray
    uses: np.ndarray


_COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]
)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count letter trigrams and scripts per language over all labelled documents.

    The sums, at most ``BUCKETS`` plus the scripts per language, come to the driver.
    Rows without a text or a language teach nothing.
    """
    labelled = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held = Reader(), {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                for kind, n in enumerate(counts):
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])],
                        names=["lang", "kind", "bucket", "n"],
                    )
            held.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for first, last in _parts(own):
                    letters = read(own[first:last])
                    counts = held.setdefault(lang, [np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)])
                    counts[0] += np.bincount(letters.buckets, minlength=BUCKETS)
                    counts[1] += np.bincount(letters.scripts, minlength=len(SCRIPTS))
                if len(held) >= HELD:
                    yield from rows()
        yield from rows()

    sums = map_arrow(labelled, count, _COUNTS).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPTS)))
    rows = np.searchsorted(langs, sums["lang"]) if len(langs) else np.empty(0, int)
    for kind, table in enumerate((counts, scripts)):
        of = (sums["kind"] == kind).to_numpy()
        table[rows[of], sums["bucket"].to_numpy()[of]] = sums["n"].to_numpy()[of]
    scores = np.log(counts + 0.1) - np.log(counts.sum(1, keepdims=True) + 0.1 * BUCKETS) if len(langs) else counts
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(scores.T, np.float32), uses)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word. ``scores``: words by languages; ties go to the first language.

    Where no stretch of words favours other languages than the overall best by more than one
    change costs, the best path never changes, and no search is needed.
    """
    best = int(scores.sum(0).argmax())
    lead = scores.max(1) - scores[:, best]
    against = np.where(lead > 0, lead, _second(scores, best) - scores[:, best])
    run = np.concatenate(([0.0], np.cumsum(against)))
    if (run - np.minimum.accumulate(run)).max() < penalty:
        return np.full(len(scores), best)
    held, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(held)
        change, source = top - penalty, held.index(top)
        step, new = [], []
        for k, s in enumerate(row):
            if held[k] >= change:
                step.append(k)
                new.append(held[k] + s)
            else:
                step.append(source)
                new.append(change + s)
        back.append(step)
        held = new
    path = [held.index(max(held))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def _second(scores: np.ndarray, best: int) -> np.ndarray:
    others = np.delete(scores, best, axis=1)
    return others.max(1) if others.shape[1] else np.full(len(scores), -np.inf)


class Labeller:
    """Labels the words of texts with a model."""

    def __init__(self, model: Model, penalty: float) -> None:
        self.model, self.penalty, self.read = model, penalty, Reader()

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int]]]]:
        """Per text: language, share of its letters, spans (language, letters)."""
        letters = self.read(texts)
        langs = self.model.langs
        if not langs or not len(letters.word_first):
            yield from ((UNKNOWN, 0.0, []) for _ in texts)
            return
        words = np.add.reduceat(self.model.scores[letters.buckets].astype(np.float64), letters.word_first, axis=0)
        allowed = self.model.uses.T[letters.scripts[letters.word_first]]
        words = np.where(allowed | ~allowed.any(1, keepdims=True), words, words.min() - 1000.0)
        sizes = np.diff(np.append(letters.word_first, len(letters.buckets)))
        edges = np.searchsorted(letters.word_text, np.arange(len(texts) + 1))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if first == last:
                yield UNKNOWN, 0.0, []
                continue
            path, own = viterbi(words[first:last], self.penalty), sizes[first:last]
            cuts = np.flatnonzero(np.diff(path)) + 1
            spans = [
                (langs[path[a]], int(own[a:b].sum()))
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(path)], strict=True)
            ]
            share = np.bincount(path, weights=own, minlength=len(langs))
            top = int(share.argmax())
            yield langs[top], float(share[top] / share.sum()), spans


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``spans`` (language and letters, in order) to ``docs``.

    ``score`` is the share of the letters in spans of ``lang_pred``. Without a letter, or for a
    null text, or if nothing was learned, ``lang_pred`` is ``und`` and the score 0. A word in a script that
    no learned language uses has all languages as candidates. Columns of the three names are replaced.
    """
    added = ("lang_pred", "score", "spans")
    kept = docs.select(*(f"`{c}`" for c in without(docs.columns, added)))
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("letters", T.LongType())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    schema = T.StructType([*kept.schema.fields, *fields])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())]))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model, penalty)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for first, last in _parts(texts):
                langs, scores, spans = zip(*label(texts[first:last]), strict=True)
                spans = [[{"lang": a, "letters": n} for a, n in s] for s in spans]
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *new], names=names)

    return map_arrow(kept, run, schema)
