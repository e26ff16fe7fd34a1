"""Language identification, n-gram scores and near-duplicates."""

import math
import random
from collections import Counter

import plain_text
import numpy as np
import pytest
from gapline.llm import language_id as li
from gapline.llm import near_dedup as nd
from gapline.llm import ngram_lm as lm
from pyspark.sql import functions as F

ENGLISH = "the house of the king and their river with this water that would be there when they think"
GERMAN = "das haus der straße und nicht über schöne mädchen weil ich auch noch früh schlafen möchte"
GREEK = "το σπίτι και η θάλασσα είναι πολύ όμορφα στην ελλάδα"


def sentence(rng, words, n):
    return " ".join(rng.choice(words.split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, words, 60), lang) for i in range(40) for lang, words in (("en", ENGLISH), ("de", GERMAN), ("el", GREEK))]
    return spark.createDataFrame([*rows, (1, None, "xx"), (2, "words", None)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return li.train(labelled)


def test_languages_of_whole_and_mixed_texts(spark, model):
    assert model.langs == ["de", "el", "en"]
    rng = random.Random(2)
    mixed = sentence(rng, ENGLISH, 80) + " 12 -- " + sentence(rng, GERMAN, 30) + "\n" + sentence(rng, ENGLISH, 50)
    rows = [(1, sentence(rng, GERMAN, 30)), (2, mixed), (3, None), (4, " 12 --"), (5, ""), (6, "Ελλάδα"), (7, "мир")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    assert got[1].lang_pred == "de" and got[1].score == 1.0
    assert got[2].lang_pred == "en" and [s.lang for s in got[2].spans] == ["en", "de", "en"] and 0.5 < got[2].score < 1
    assert [(got[k].lang_pred, got[k].score) for k in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[6].lang_pred == "el" and got[7].lang_pred in model.langs


def test_nothing_learned_is_und(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in li.identify(docs, li.train(empty)).collect()] == [("und", 0.0)]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in [1, 2, 5, 40] * 20:
        scores = rng.normal(size=(n, 3)) * rng.choice([0.1, 1, 5])
        path = li.viterbi(scores, 3.0)
        value = scores[np.arange(n), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        best = scores[0]
        for row in scores[1:]:
            best = row + np.maximum(best, best.max() - 3.0)
        assert value == pytest.approx(best.max())


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("Aa b c dd e\u00e9 f g".split()) for _ in range(rng.randint(0, 30)))) for i in range(n)]


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(lm, "BATCH_CHARS", 200)
    monkeypatch.setattr(lm, "SHARD_CHARS", 150)


def test_unigram_counts_and_scores(spark, small_batches):
    docs = [*corpus(3, 60), (60, None), (61, "unseen words")]
    taught = {i for i, _ in docs if plain_text.remainder(i, 10) != 0 and i != 61}
    got = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id").isin(taught)).collect()
    assert len(got) == len(docs)
    tokens = {i: [*plain_text.spaced(t), None] for i, t in docs}
    seen = Counter(t for i in taught for t in tokens[i])
    total, types = sum(seen.values()), len(seen)
    for r in got:
        own = tokens[r.doc_id]
        base = sum(math.log10((seen[t] + 0.1) / (total + 0.1 * (types + 1))) for t in own)
        known = sum(seen[t] > 0 for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in taught, len(own), known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_bigram_counts_are_exact(spark, small_batches):
    docs = corpus(4, 50)
    counts, total, types, starts = lm.counted(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 40, "doc_id", "text")
    tokens = {i: ["<s>", *plain_text.spaced(t), "</s>"] for i, t in docs}
    pairs = Counter(p for i in range(40) for p in zip(tokens[i], tokens[i][1:]))
    assert starts == 40 and total == sum(len(tokens[i]) - 1 for i in range(40))
    for r in counts.collect():
        own = tokens[r.doc]
        assert lm._numbers(r.pairs).tolist() == [pairs[p] for p in zip(own, own[1:])]


def test_probabilities_of_a_context_sum_to_one():
    # Context seen 8 times, followed by three types; five types in 40 tokens, and the unknown one.
    weights = lm.Weights(np.tile([0.5, 0.3, 0.2], (65, 1)), 40, 5, 8)
    singles, pairs = np.array([8, 10, 12, 6, 4, 0]), np.array([4, 3, 1, 0, 0, 0])
    each = [lm.probabilities(np.array([s]), np.array([p]), weights)[0] for s, p in zip(singles, pairs)]
    assert sum(each) == pytest.approx(1.0)


def test_weights_prefer_bigrams_that_tell(spark, small_batches):
    fixed = [(i, "one two three four five six seven eight " * 3) for i in range(30)]
    counts, *sizes = lm.counted(spark.createDataFrame(fixed, "doc_id long, text string"), F.lit(True), "doc_id", "text")
    weights = lm.learn_weights(counts, *sizes)
    assert weights.mix[7, 0] > 0.9 and np.allclose(weights.mix.sum(1), 1)


def test_scores_with_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in got] == [(True, 0, 0)] * 2
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 40, 150]))]
        for _ in range(rng.randint(1, 8)):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else w for w in base]
            docs.append(" ".join(copy) if rng.random() < 0.5 else "  ".join(copy).upper())
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_plain_python(spark, seed):
    docs = near_copies(seed)
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, component string")
    got = {r.doc_id: r for r in nd.find_components(table).collect()}
    want = plain_text.components(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(plain_text.shingles(t)) for i, t in docs}
    kept = nd.one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_copies_empty_texts_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (3, text), (3, text), (9, ""), (8, None), (7, " "), (None, text), (None, None), (6, "Only four Words here"), (4, "only four words here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in nd.find_components(table).collect())
    assert got == Counter([(5, 26, 3), (3, 26, 3), (3, 26, 3), (9, 0, 9), (8, 0, 8), (7, 0, 7), (None, 26, None), (None, 0, None), (6, 1, 4), (4, 1, 4)])
    assert nd.one_of_each(table).count() == 8
    assert nd.find_components(table.limit(0)).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(2, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (3, None, "z", 3)]
    kept = nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _copy string, Component_ID int"))
    assert sorted((r.doc_id, r._copy, r.Component_ID) for r in kept.collect()) == [(1, "y", 2), (3, "z", 3)]


def test_texts_that_share_an_id_share_a_component(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    table = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b)], "doc_id long, text string")
    assert {r.component_id for r in nd.find_components(table).collect()} == {1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in nd.components(links).collect()} == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_the_index_meets_every_close_pair(spark):
    """Signatures with up to 31 other slots share a key, and meet at just one of their keys."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        slots = [rng.randrange(1 << nd.BITS) for _ in range(nd.SLOTS)]
        other = list(slots)
        for k in rng.sample(range(nd.SLOTS), rng.randint(0, nd.DISTANCE)):
            other[k] ^= 1 + rng.randrange((1 << nd.BITS) - 1)
        packed = [
            [sum(s[c * 4 + k] << (nd.LANE * k) for k in range(4)) for c in range(nd.CHUNKS)] + [0] * nd.WORDS for s in (slots, other)
        ]
        rows.append((n, *packed))
    pairs = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    left, right = (pairs.select("n", F.col(c).alias(c), F.inline(nd.index_keys(F.col(c)))) for c in "ab")
    met = left.join(right, ["n", "key", "place"]).where(nd._met_first(F.col("a"), F.col("b"), F.col("place")))
    assert sorted(r.n for r in met.select("n").collect()) == list(range(60))
    one = F.lit(100)
    assert pairs.where(nd.close(F.col("a"), F.col("b"), one, one)).count() == 60
