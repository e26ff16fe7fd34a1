"""The operators' results by plain Python, text by text."""

import re
import zlib
from collections import Counter
from hashlib import sha256

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text, lower=True):
    return SPACED.findall((text or "").translate(UPPER) if lower else text or "")


def alphanumeric(text):
    return ALPHANUMERIC.findall((text or "").translate(UPPER))


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def quality(text):
    text = text or ""
    words = spaced(text, lower=False)
    grams = list(zip(words, words[1:], words[2:]))
    many = Counter(grams)
    covered = {k + s for k, g in enumerate(grams) if many[g] > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def base_failed(text):
    q = quality(text)
    return q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"]


def shingles(text):
    words = spaced(text)
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(docs):
    """{id: component} of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def overlaps(text, items, window=10):
    """Hit words, and ids of items found, of (id, text) items."""
    words, hit, found = alphanumeric(text), set(), set()
    for name, item in items:
        own = alphanumeric(item)
        size = min(window, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(name))
    return hit, sorted(found)


def digest(names):
    return sha256(",".join(names).encode()).hexdigest()


def phrases(text, wanted):
    """(place, label) of every phrase."""
    words, out = alphanumeric(text), []
    for label, phrase in wanted:
        own = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    return out
