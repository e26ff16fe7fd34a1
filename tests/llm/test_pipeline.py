"""The pipeline against a brute-force version of its stages, on made-up documents."""

import random

import plain_text
import corpus_pipeline
import pytest
from gapline.llm import piece_codec as pc
from gapline.llm.queries import piece_model

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"en": "the of and to in water house river think there", "de": "der die und nicht über schön straße mädchen früh noch"}


def documents(seed):
    rng = random.Random(seed)
    rows = []

    def add(text, lang="en", source=None):
        rows.append((len(rows), text, lang, source or f"s{len(rows) % 3}", len(text or "")))

    for k in range(30):
        lang = rng.choice(list(LANGS))
        base = [f"{rng.choice(LANGS[lang].split())}{rng.choice('abcdefgh')}" for _ in range(rng.randint(60, 90))]
        add(" ".join(base), lang)
        if k % 4 == 0:
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            add(" ".join(copy), lang)
        if k % 7 == 0:
            add(" ".join(base), lang)
    items = [(k, " ".join(f"item{k}w{j}" for j in range(14))) for k in range(4)]
    add(rows[1][1] + " " + items[0][1] + " tail", rows[1][2])
    add(items[1][1] + " " + " ".join(f"more{j}" for j in range(40)) + " " + items[2][1], "en")
    add(" ".join(t for _, t in items) + " some last words", "en")  # mostly items
    add("too short", "en")
    add("again and again " * 40, "en")
    add("12 34 56 " * 20 + " ".join(str(k * 7919) for k in range(60)), None)  # no letters
    add(None, None)
    add("", "en")
    return rows, items


def expected(rows, items):
    """(doc_id, text) of what comes out, by plain Python; languages are not in doubt here."""
    kept = [(i, t) for i, t, *_ in rows if not plain_text.base_failed(t)]
    kept = [(i, t) for i, t in kept if any(c.isalpha() for c in t)]
    group = plain_text.components(kept)
    out = {}
    for i, t in kept:
        if group[i] != i:
            continue
        hit, _ = plain_text.overlaps(t, items)
        words = plain_text.alphanumeric(t)
        if len(hit) > 0.5 * len(words):
            continue
        out[i] = (t, sorted(hit))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_match_plain_python(spark, tmp_path, seed):
    rows, items = documents(seed)
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = expected(rows, items)
    vocabulary = piece_model()
    got = {r.doc_id: r for r in pc.decode(corpus_pipeline.run(spark, str(tmp_path)), vocabulary).collect()}
    assert got.keys() == want.keys()
    for i, (text, hit) in want.items():
        assert got[i].n_tokens == len(got[i]["ids"])
        if not hit:
            assert got[i].decoded == text
        left = [w for k, w in enumerate(plain_text.alphanumeric(text)) if k not in hit]
        assert plain_text.alphanumeric(got[i].decoded) == left


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = documents(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontaminate", "piece_codec"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()


def test_short_items_are_cut(spark, tmp_path):
    rows, items = documents(4)
    items += [(10, "Short item of five words"), (11, "lone")]
    clean = rows[0][1]
    text = clean + ". Short item, of five words; " + "and so on to the end of it, lone"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, clean, "en", "s", len(clean))], COLUMNS)
    got = {r.doc_id: r for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()}
    assert got[1].text == clean + ". ; and so on to the end of it, " and got[1].n_chars == len(got[1].text)
    assert got[2].text == clean
    assert plain_text.overlaps(got[1].text, items) == (set(), [])


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
