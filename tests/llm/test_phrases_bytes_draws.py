"""Byte-level BPE, phrase mining and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain_text
import public_tokenizers
import pytest
import tiktoken
from conftest import TESTDATA
from gapline.llm import byte_bpe, collocations, importance, queries
from pyspark.sql import functions as F

RANKS = queries.byte_ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
ODD = ["", " ", "  ", "a", " 'll", "it's  we'RE\n\n x", "x" * 3000, "ab " * 700, " " * 900 + "y", "中文字" * 400, "<|endoftext|> a", "é́🙂\x00\x85", "'" * 50]


# --- byte-level BPE


@pytest.mark.parametrize("leaf", [1, 3, 8, 64])
def test_ids_by_halves_are_the_librarys(leaf):
    rng = random.Random(leaf)
    encoder = byte_bpe.ByteEncoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, leaf=leaf)
    bits = ["'", "l", "r", "e", " ", "  ", "\n", "a", "é", "中", "1", ".", "́", "s", "ll", " the", "\t", "xyz", "🙂"]
    for text in ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(500)]:
        assert encoder(text) == LIBRARY.encode_ordinary(text)


def test_long_matches_are_joined_by_tokens():
    rng = random.Random(3)
    encoder = byte_bpe.ByteEncoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, long=1)
    assert encoder.long == 2 * max(map(len, encoder.ranks)) + 2
    for text in ("a" * 9001, "ab" * 2000 + "c" * 777, "".join(rng.choice("abcdefgh") for _ in range(6000)), "." * 3001):
        assert encoder.long_ids(text.encode()) == LIBRARY.encode_ordinary(text)


@pytest.fixture(scope="module")
def texts(spark):
    some = [r.text for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(k, t, "own") for k, t in enumerate([*some, *ODD])]
    return [*rows, (None, None, None), (1, some[1], "again"), (1, some[1], "again")]


@pytest.mark.parametrize("giant, fan", [(1 << 20, 8), (400, 2), (150, 3)])
def test_giant_texts_have_the_same_ids(spark, texts, giant, fan):
    docs = spark.createDataFrame(texts, "doc_id long, text string, _row string").withColumn("ids", F.lit(0))
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, giant=giant, fan=fan, leaf=32)
    decoded = byte_bpe.decode(encoded.withColumn("decoded", F.lit("old")), RANKS)
    got = sorted(((r.doc_id, r._row, r.text, r.ids, bytes(r.decoded)) for r in decoded.collect()), key=repr)
    want = [(i, own, t, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, own in texts]
    assert got == sorted(want, key=repr)


def test_chunks_of_a_giant_text_are_dealt_out(spark, monkeypatch):
    seen = []

    def spy(df, name, write=byte_bpe.written):
        out = write(df, name)
        if name == "parts":
            seen.append((df.rdd.getNumPartitions(), out.select("k").collect()))
        return out

    monkeypatch.setattr(byte_bpe, "written", spy)
    docs = spark.createDataFrame([(1, "some words " * 4000)], "doc_id long, text string").coalesce(1)
    assert byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, giant=1000).count() == 1
    assert seen[0][0] == 8 and len(seen[0][1]) == 44 and [len(k) for _, k in seen[1:]] == [6, 1]


def test_byte_bpe_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).columns == ["doc_id", "text", "ids", "decoded"]
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).isEmpty()


def test_byte_bpe_query(spark):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, f"{TESTDATA}/sf0.001").collect()
    assert len(got) == len(documents)
    for r in got:
        ids = LIBRARY.encode_ordinary(documents[r.doc_id])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(documents[r.doc_id].encode()).hexdigest())


# --- phrases


def mined(rows, max_words=4, min_count=30, top=2000):
    """``collocations.mine_phrases`` for (lang, text) rows, the slow and obvious way."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain_text.UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, max_words + 1):
                own.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in found.items():
            inside = any(100 * b >= 80 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def random_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "a", "new", "york", "city", "straße", "中文", "x\x85y", "ÉTÉ", "b-c"]

    def text():
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]) for _ in range(rng.randrange(40)))

    rows = [(rng.choice(["en", "de", None]), text()) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("fr", "only once"), *[("en", "New York City, new york")] * 40, ("de", "of " * 300)]


@pytest.mark.parametrize("shard_words, max_words, min_count, top", [(60, 4, 5, 2000), (1, 3, 2, 7), (1 << 20, 2, 1, 50)])
def test_phrases(spark, shard_words, max_words, min_count, top):
    rows = random_rows(shard_words, 60)
    docs = spark.createDataFrame([(t, x, 1) for x, t in rows], "text string, lang string, w1 int").repartition(3)
    got = collocations.mine_phrases(docs, max_words=max_words, min_count=min_count, top=top, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == mined(rows, max_words, min_count, top)


@pytest.mark.parametrize("max_words, part_words, a_core", [(4, 1, 2), (3, 1 << 24, 2), (4, 1 << 24, 0)])
def test_shards_of_a_part_send_a_row_per_longest_phrase(spark, monkeypatch, max_words, part_words, a_core):
    rows, seen = random_rows(max_words, 60) + [(t, "One two three four five") for t in ("en", "de", None) for _ in range(40)], []

    def spy(index, frequent, size, parts, made=collocations.longest_phrases):
        out = collocations.written(made(index, frequent, size, parts), "made")
        seen.append((size, out.count(), out.select(*collocations._words(size + 1)).distinct().count(), [r.part for r in parts.collect()]))
        return out

    monkeypatch.setattr(collocations, "longest_phrases", spy)
    monkeypatch.setattr(collocations, "PARTS_A_CORE", a_core)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(24)
    got = collocations.mine_phrases(docs, max_words=max_words, min_count=3, part_words=part_words)
    assert sorted(map(tuple, got.collect())) == mined(rows, max_words, 3)
    [(size, made, distinct, parts)] = seen
    assert size == max_words - 1 and len(parts) > 30
    if part_words == 1:  # a shard each
        assert len(set(parts)) == len(parts) and made > 2 * distinct
    elif a_core:  # 16 for 8 cores, and what is left over of each language
        assert 8 < len(set(parts)) <= 20 and distinct < made
    else:  # a language each
        assert len(set(parts)) <= 4 and made == distinct


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    words = ["ab", "c" * 70, "de"] * 40
    texts = pa.array(["", " ".join(words), "x", "y" * 500, ". ".join(words)])
    parts, owners = collocations.bounded(texts, collocations.WORD, limit=50)
    joined = {}
    for part, owner in zip(parts.to_pylist(), owners.tolist(), strict=True):
        joined[owner] = joined.get(owner, "") + part
    assert [joined.get(k, "") for k in range(5)] == texts.to_pylist()
    assert max(len(p) for p, o in zip(parts.to_pylist(), owners, strict=True) if o in (1, 4)) <= 50 + 73
    monkeypatch.setattr(collocations, "bounded", lambda t, w, bounded=collocations.bounded: bounded(t, w, limit=50))
    for rows in (texts, texts.slice(1, 1)):
        collector = collocations.Collector(10**6)
        assert not list(collector.add(rows))
        hashes, spelled = collector.shard()
        got = [spelled[h].decode() if h else "|" for h in hashes.tolist()]
        want = [w for t in rows.to_pylist() for p in t.split(".") if p for w in ("|", *p.split())]
        assert got == want


@pytest.mark.parametrize("rows", [1, 50, 1 << 17])
def test_intervals_extend_both_ways(rows, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(0, 5, 400), 0).astype(np.uint16)
    assert collocations._unpacked(collocations._packed(symbols)).tolist() == symbols.tolist()
    left = collocations.Index(collocations.transform(symbols, 4))
    right = collocations.Index(collocations.transform(np.append(symbols[:-1][::-1], 0), 4))
    counts = np.bincount(symbols)
    lows = np.cumsum(counts) - counts
    phrases = [((c,), lows[c], lows[c], counts[c]) for c in range(1, 5)]
    text = symbols.tolist()
    for size in (2, 3, 4):
        low, other, n = (np.array([p[k] for p in phrases]) for k in (1, 2, 3))
        owner, many, new, new_other = left.extended(low, n, other)
        back = {x: k for k, x in enumerate(right.extended(other, n, low)[3])}
        heads = right.extended(other, n, low)[0]
        phrases = [((*phrases[heads[back[x]]][0], phrases[o][0][-1]), x, y, m) for o, m, x, y in zip(owner, many, new, new_other, strict=True)]
        want = Counter(tuple(text[k : k + size]) for k in range(len(text) - size + 1) if 0 not in text[k : k + size])
        assert {p[0]: p[3] for p in phrases} == want


def test_phrases_of_nothing(spark):
    assert collocations.mine_phrases(spark.createDataFrame([], "lang string, text string")).isEmpty()
    nulls = spark.createDataFrame([(None, None), ("en", " .,")], "lang string, text string")
    assert collocations.mine_phrases(nulls).isEmpty()


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**15
    grams = spark.createDataFrame([([1], big), ([2], big - 1), ([1, 2], big - 3)], "ws array<long>, f long")
    assert collocations.score_phrases(grams).first().score == 2000000 * (big - 3) // (2 * big - 1)


# --- importance


def drawn(rows, target, longest=1, buckets=importance.BUCKETS, least=20, percent=10):
    def features(text):
        words = plain_text.alphanumeric(text)
        runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
        return Counter(zlib.crc32(r.encode()) % buckets for r in runs), len(words)

    own = [(i, *features(t)) for i, t in rows]
    s, t = sum((c for _, c, _ in own), Counter()), sum((features(x)[0] for x in target), Counter())
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, c, n in own:
        weight = sum(k * math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, sum(c.values()), weight, score])
    ranked = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    places = {}
    for place, r in enumerate(ranked[: percent * len(ranked) // 100], 1):
        places.setdefault(r[0], []).append(place)
    return out, places


def check_draw(got, rows, target, **settings):
    want, places = drawn(rows, target, **settings)
    key = lambda r: [str(x) for x in r]
    assert sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score] for r in got), key=key) == sorted(want, key=key)
    found = {}
    for r in got:
        if r["rank"] is not None:
            found.setdefault(r.doc_id, []).append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == places


@pytest.mark.parametrize("longest, buckets, least, percent", [(1, 10000, 20, 10), (3, 50, 0, 37), (2, 10000, 5, 100)])
def test_draw(spark, longest, buckets, least, percent):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "γάμμα", "4", "d", "x" * 300, "Ünï"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(" .\n-") for _ in range(rng.randrange(80)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "..."), (None, rows[5][1]), (63, "one " * 9000), *[(64, rows[7][1])] * 5]
    target = [rows[0][1], "beta d 4", None, ""]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rn int, Score int").repartition(4)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "rn", *importance.ADDED]
    check_draw(got.collect(), rows, target, longest=longest, buckets=buckets, least=least, percent=percent)


def test_draw_from_and_for_nothing(spark):
    schema = "doc_id long, text string"
    empty, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a b")], schema)
    assert importance.resample(empty, one).isEmpty()
    check_draw(importance.resample(one, empty).collect(), [(1, "a b")], [])
    check_draw(importance.resample(one, empty, least_words=1, percent=100).collect(), [(1, "a b")], [], least=1, percent=100)


def test_splitter_finds_the_same_words():
    featurizer = importance.Featurizer(10, 1, 1)
    text = "It's 1-a  wörld_x\x00\x7f中文 é\n" * 500 + "z" * 9000
    words = [w for block in featurizer.words(text) for w, _ in block]
    assert words == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [text[a:b] for w, (a, b) in featurizer.split("Über 'x1'")]
    assert len(at) == 2
