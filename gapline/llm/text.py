"""Words and their hashes, found in Arrow text columns with numpy.

A batch of texts is one run of UTF-8 bytes. Word characters are a table over byte
values (bytes from 128 on belong to words), so words are found and hashed for many
texts at once, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. Arrays over bytes take about 40 times this.
SLICE_BYTES = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spaced() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = np.ones(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        table[low : high + 1] = False
    return table


SPACED, ALPHANUMERIC = _spaced(), _alphanumeric()


class Words(NamedTuple):
    """Words of some texts: hash, place in the bytes, and the text each belongs to."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


class Hasher:
    """Hashes of byte ranges by a polynomial over scrambled byte values, modulo 2**64."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        self.values, self.up, self.down = _byte_values(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers_for(self, size: int) -> None:
        if len(self.up) < size + 1:
            n = 2 * size + 1
            self.up = _powers(self.BASE, n)
            self.down = _powers(pow(self.BASE, -1, 1 << 64), n)

    def raw(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers_for(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]

    def of_values(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges of any 64-bit values."""
        self._powers_for(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ranges must be sorted and apart; long texts go piece by piece."""
        if len(data) <= 2 * SLICE_BYTES or not len(starts):
            return mixed(self.raw(data, starts, ends)) if len(starts) else np.empty(0, np.uint64)
        out, first = [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")))
            low, high = int(starts[first]), int(ends[last - 1])
            if high - low <= 2 * SLICE_BYTES:
                out.append(self.raw(data[low:high], starts[first:last] - low, ends[first:last] - low))
            else:
                out.append(self._long(data[low:high]))
            first = last
        return mixed(np.concatenate(out))

    def _long(self, data: np.ndarray) -> np.ndarray:
        total, zero = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        for at in range(0, len(data), SLICE_BYTES):
            piece = data[at : at + SLICE_BYTES]
            total += self.raw(piece, zero, zero + len(piece)) * np.uint64(pow(self.BASE, at, 1 << 64))
        return total


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data | np.uint8(0x20), data)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    ends = text_bytes(texts)[0]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows in the bytes, and the bytes."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return rows, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def with_columns(batch: pa.RecordBatch, **added: pa.Array) -> pa.RecordBatch:
    """The batch with columns appended, after any of the same names are left out."""
    kept = [k for k, name in enumerate(batch.schema.names) if name not in added]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k) for k in kept), *added.values()], names=[*(batch.schema.names[k] for k in kept), *added]
    )


def column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with empty texts for nulls."""
    texts = batch.column(batch.schema.get_field_index(name))
    return texts.fill_null("") if texts.null_count else texts


def words_of(texts: pa.Array, is_word: np.ndarray, hasher: Hasher, lower: bool = True) -> Words:
    """The words of some texts (see ``slices``: one slice at a time)."""
    offsets, data = text_bytes(texts)
    if len(offsets) < 2:
        offsets = np.zeros(1, np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if lower:
        data = lowered(data)
    inside = is_word[data]
    begins, ends = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        begins[0], begins[1:] = inside[0], inside[1:] & ~inside[:-1]
        ends[-1], ends[:-1] = inside[-1], inside[:-1] & ~inside[1:]
        edges = offsets[1:-1]
        at = edges[(edges > 0) & (edges < len(data))]
        begins[at] |= inside[at]
        ends[at - 1] |= inside[at - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = hasher(data, starts, stops)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(rows, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return Words(hashes, starts, stops, rows, counts, data, offsets)


def gathered(store: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a store, by their numbers, end to end; and their lengths."""
    sizes = starts[numbers + 1] - starts[numbers]
    shift = starts[numbers] - (np.cumsum(sizes) - sizes)
    return store[np.arange(sizes.sum()) + np.repeat(shift, sizes)], sizes


def summed(per_byte: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte quantity between neighbouring offsets."""
    sums = np.zeros(len(per_byte) + 1, np.int64)
    np.cumsum(per_byte, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``size`` consecutive words at each place, and whether they are of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mixed(out * MULTIPLIER + hashes[k : k + n])
    return out, rows[:n] == rows[size - 1 :]
