"""Encoding with a lower-casing word BPE of the tokenizers library, piece by piece.

The vocabulary's own pre-tokenizer cuts a text into pieces that are encoded independently,
so a piece that was seen before need not be encoded again. Texts of Latin letters are cut
here, many at once by numpy, and pieces are known by 64-bit hashes; all other texts, and
texts that spell a special token, go to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from gapline.llm import text as tx

#: Code points up to here are their own NFC form and are lower-cased alike everywhere.
LAST = 0x24F
#: Pieces that a worker process remembers; beyond it forgets those it has not met for longest.
REMEMBERED = 1_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
# What the vocabulary's pre-tokenizer takes off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> np.ndarray:
    """Kind of each code point that lower-cased Latin text can hold."""
    kinds = np.full(0x370, OTHER, np.int8)
    for c in range(LAST + 1):
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kinds[[0x20, *range(0x09, 0x0E), 0x85, 0xA0]] = SPACE
    return kinds


class Cutter:
    """Cuts lower-cased texts as the vocabulary does.

    Pieces are runs of letters, single numbers, and runs of other characters; an apostrophe
    that is a run of its own takes one of ``ENDINGS`` from the letters behind it.
    """

    def __init__(self) -> None:
        self.kinds = _kinds()

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of code points that begin and end with a space."""
        kind = self.kinds[codes]
        new = np.ones(len(codes), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(codes))
        starts, ends = starts[kind[starts] != SPACE], ends[kind[starts] != SPACE]
        alone = (codes[starts] == ord("'")) & (ends - starts == 1)
        followed = np.flatnonzero(alone[:-1] & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == LETTER))
        if not len(followed):
            return starts, ends
        taken = np.zeros(len(followed), np.int64)
        first = starts[followed + 1]
        room = ends[followed + 1] - first
        for ending in ENDINGS:  # no ending begins with another
            fits = room >= len(ending)
            for k, c in enumerate(ending):
                fits &= codes[np.minimum(first + k, len(codes) - 1)] == ord(c)
            taken[fits] = len(ending)
        starts, ends = starts.copy(), ends.copy()
        ends[followed] += taken
        starts[followed + 1] += taken
        kept = ends > starts
        return starts[kept], ends[kept]


class Pieces:
    """Ids of the pieces of many texts, each piece encoded by the library just once."""

    def __init__(self, library, ends: np.ndarray) -> None:
        self.library, self.ends = library, ends
        self.cut, self.hasher = Cutter(), tx.Hasher()
        self.values = tx.mixed(np.arange(1, len(self.cut.kinds) + 1, dtype=np.uint64))
        # Sorted hashes and their numbers; per number the ids (from starts on) and when it was last met.
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met, self.now, self.swept = np.empty(0, np.int64), 0, 0

    def _forget(self) -> None:
        """Keep the pieces met since the last time, if they are not too many themselves."""
        fresh = self.met > self.swept
        kept = np.flatnonzero(fresh) if 2 * fresh.sum() <= REMEMBERED else np.empty(0, np.int64)
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        numbers = place[self.numbers]
        self.hashes, self.numbers = self.hashes[numbers >= 0], numbers[numbers >= 0]
        self.ids, sizes = tx.gathered(self.ids, self.starts, kept)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.met, self.swept = self.met[kept], self.now

    def _learn(self, new: list[str], hashes: np.ndarray) -> None:
        """Encode new pieces, many at a time: a piece's last id is one that ends a word."""
        lines = [" ".join(new[k : k + 500]) for k in range(0, len(new), 500)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("a piece was not encoded as one word")
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.numbers = np.insert(self.numbers, at, len(self.met) + np.arange(len(new)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + ends))
        self.ids = np.concatenate((self.ids, ids))
        self.met = np.concatenate((self.met, np.full(len(new), self.now)))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes are or would be, and whether they are known."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return at, known

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        lowered = [t.lower() for t in texts]
        joined = "\n".join(["", *lowered, ""])
        codes = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = self.cut(codes)
        begins = np.cumsum([1, *(len(t) + 1 for t in lowered)])[:-1]
        owner = np.searchsorted(begins, starts, side="right") - 1
        distinct, first, at = np.unique(self.hasher.of_values(self.values[codes], starts, ends), return_index=True, return_inverse=True)
        self.now += 1
        if len(self.met) > REMEMBERED:
            self._forget()
        _, known = self._places(distinct)
        if not known.all():
            new = first[~known]
            self._learn([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], distinct[~known])
        numbers = self.numbers[self._places(distinct)[0]]
        self.met[numbers] = self.now
        ids, sizes = tx.gathered(self.ids, self.starts, numbers[at])
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(counts)[:-1])


def _of_this_worker(name: str, make: Callable):
    """``make()``, once per worker process: code that comes with a task is loaded anew for each."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_between_tasks", {})
    if name not in kept:
        kept.clear()  # a worker holds one vocabulary
        kept[name] = make()
    return kept[name]


def word_encoder(tokenizer_json: str, end_id: int | None = None) -> Callable[[], Callable[[list[str]], Iterator[np.ndarray]]]:
    """A maker of encoders (see ``write_segments``) for the tokenizer file's contents."""
    special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]

    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(tokenizer_json)
        vocabulary = library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[n for piece, n in vocabulary.items() if piece.endswith("</w>")]] = True
        return Pieces(library, ends)

    def make() -> Callable[[list[str]], Iterator[np.ndarray]]:
        pieces = _of_this_worker(name, load)
        plain = re.compile(f"[\\x00-{chr(LAST)}]*")
        tail = [] if end_id is None else [end_id]

        def encode(texts: list[str]) -> Iterator[np.ndarray]:
            here = [bool(plain.fullmatch(t)) and not any(s in t for s in special) for t in texts]
            found = {}
            # Texts of ASCII only take an eighth of the memory, and less time.
            for ascii_only in (True, False):
                own = [k for k, t in enumerate(texts) if here[k] and t.isascii() == ascii_only]
                if own:
                    found |= zip(own, pieces([texts[k] for k in own]), strict=True)
            for k, text in enumerate(texts):
                ids = found[k] if here[k] else pieces.library.encode(text, add_special_tokens=False).ids
                yield np.concatenate((ids, tail)).astype(np.uint32)

        return encode

    return make
