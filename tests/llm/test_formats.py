"""HTML extraction, piece encoding and token files: exact results and round trips."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from gapline.llm import piece_codec as pc
from gapline.llm import token_files as tf
from gapline.llm.html_text import extract_text, main_text
from gapline.llm.queries import piece_model
from gapline.llm import html_text, word_bpe
from gapline.llm.word_bpe import word_encoder
from gapline.sources.scratch import scratch_path
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

ODD = ["", " ", "a", "  a  b\n\n c\t", "▁ x▁▁ y", "中文 🙂 aaa", "\x01\x02 \x01\x01", "x" * 300, "It's John'S 12³ ½ don't", "ſtraße İstanbul ŉ", "a\x1cb\x85c\xa0d", "<|endoftext|> a <s>"]


def texts_of(spark, n):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [r.text for r in rows] + ODD


PAGES = {
    "<p>No article: just one text, of some length.</p><nav>Menu</nav>": "No article: just one text, of some length.",
    "<body><div class='side-bar sidebar'>Side text, long enough to win, with commas, and more.</div><div id=content><h2>Title</h2><p>First  par.</p><p>Second &amp; last.</div></body>": "Title\nFirst par.\nSecond & last.",
    "<article><header><h1>Head</h1></header><p>A<b>B</b>\n c<br>d<p><b>E<p>F</article><footer>No</footer>": "Head\nAB c d\nE\nF",
    "<main><p>Kept.</p><section class='comments'><article><p>A comment, much longer than the text itself, with commas.</p></article></section></main>": "Kept.",
    "<article><script>if (a</b) '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>1 &lt; 2 &nbsp;&#233;&eacute;</p><form><label>No</label></form></article>": "1 < 2 éé",
    "<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>": "one\ntwo\nc1\nc2",
    "plain": "plain", "": "", "<": "<", "<article>unclosed <b>bold": "unclosed bold", "<p title='a > b'>x</p>": "x",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


BODY = "<h1>Title</h1><p>A first sentence, with commas.</p><p>A second one.</p>"
READ = "Title\nA first sentence, with commas.\nA second one."
NAMED = {
    f"<html class='has-navbar'><body class='sticky-header'><nav>Menu</nav><article class='post category-social'>{BODY}</article>": READ,
    f"<main class='with-sidebar'>{BODY}<div class=sidebar>Side</div></main>": READ,
    f"<body><div class='page-with-sidebar'>{BODY}<div class='left-sidebar'>Side, text.</div></div></body>": READ,
    f"<body><div class=widget>{BODY}</div></body>": READ,
    f"<body><div class=widget>{BODY}</div><footer>Foot</footer><div class=search>Find</div></body>": READ,
    "<body><div id=search><p>All there is.</p></div></body>": "All there is.",
    "<article title='The hidden life'><p>See <a title='a hidden gem'>this gem</a>.</p><p data-x='display:none'>x</p></article>": "See this gem.\nx",
    "<article><p>Kept.</p><p hidden>No</p><p hidden=''>No</p><p style='color:red;display: none'>No</p></article>": "Kept.",
    "<article><p>Kept.</p><div class='comment-list'><p>A comment that is longer, with commas, than all else.</p></div></article>": "Kept.",
}


@pytest.mark.parametrize("page", NAMED)
def test_names_do_not_take_the_article(page):
    assert main_text(page) == NAMED[page]


def prose(word, n):
    return " ".join(f"{word}{k}," for k in range(n))


SECTIONS = [f"<section id={name}><h2>{name}</h2>" + f"<p>{prose(name, n)}</p>" * times + "</section>" for name, n, times in (("intro", 4, 1), ("usage", 60, 9), ("end", 3, 1))]
SPLIT = {
    f"<div id=c><div class=lead>{prose('a', 30)}</div><div class=text>{prose('b', 200)}</div></div>": [prose("a", 30), prose("b", 200)],
    f"<div id=c><div class=lead>{'a' * 200}</div><div class=text>{'b' * 1000}</div></div>": ["a" * 200, "b" * 1000],
    f"<body><nav>Menu</nav><div class=page>{''.join(SECTIONS)}</div><footer>Foot.</footer></body>": ["intro", prose("intro", 4), "usage", *[prose("usage", 60)] * 9, "end", prose("end", 3)],
    f"<body><h1>Title</h1><div class=text><p>{prose('b', 40)}</p></div></body>": ["Title", prose("b", 40)],
    f"<body><div class=title><h1><a href=x>Title</a></h1></div><div class=text><p>{prose('b', 40)}</p></div></body>": ["Title", prose("b", 40)],
    f"<body><div class=top><a href=x>{prose('l', 40)}</a></div><div class=text><p>{prose('b', 40)}</p></div></body>": [prose("b", 40)],
    f"<body>stray<div class=box>Links, of few words.</div><article><p>{prose('b', 60)}</p><div class=x>End.</div></article></body>": [prose("b", 60), "End."],
    f"<body><div class=lead>{prose('a', 90)}</div><article><p>{prose('b', 60)}</p></article></body>": [prose("a", 90), prose("b", 60)],
    f"<div class=text>{f'<p>{prose('b', 60)}</p>' * 5}</div><div class=cards><article>A card</article></div>": [*[prose("b", 60)] * 5, "A card"],
}


@pytest.mark.parametrize("page", SPLIT)
def test_articles_in_several_containers_are_whole(page):
    assert main_text(page).split("\n") == SPLIT[page]


def test_extraction_of_a_table(spark):
    rows = [(1, None, "old"), (2, "<article>Text</article>", "x"), (2, "<article>Text</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, TEXT string").withColumnRenamed("TEXT", "text")
    got = sorted(tuple(r) for r in extract_text(pages).select("page_id", "text").collect())
    assert got == [(1, ""), (2, "Text"), (2, "Text")]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pc.Vocabulary(piece_model())


def test_pieces_round_trip_and_parts_do_not_matter(spark, vocabulary):
    texts = texts_of(spark, 60)
    ids, counts = pc.Encoder(vocabulary)(texts)
    assert vocabulary.decoded(ids, counts).to_pylist() == texts
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == vocabulary.encoded(vocabulary.spelling(text))


def best_score(vocabulary, text):
    """The largest total score, by trying every piece at every place."""
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            piece = vocabulary.pieces.get(text[start:end], (0, vocabulary.unknown if end - start == 1 else -np.inf))
            best[end] = max(best[end], best[start] + piece[1])
    return best[-1]


def test_pieces_are_the_best(spark, vocabulary):
    """Also no worse than the library's own search over the same pieces, which sums 32-bit numbers."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(piece_model())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder, scores = pc.Encoder(vocabulary), {n: s for n, s in vocabulary.pieces.values()}
    words = [w for t in texts_of(spark, 30) for w in t.split() if w.isalpha()]
    for k in range(0, len(words), 5):
        text = " ".join(words[k : k + 5])
        ids = encoder([text])[0].tolist()
        if all(i in scores for i in ids):
            assert sum(scores[i] for i in ids) == best_score(vocabulary, vocabulary.spelling(text))
            found = library.encode(text)
            assert sum(scores[i] for i in ids) >= sum(scores.get(i, vocabulary.unknown) for i in found)


@pytest.mark.parametrize(("chunk", "group"), [(17, 2), (64, 3), (200, 64)])
def test_chunks_do_not_matter(spark, vocabulary, chunk, group):
    rng = random.Random(chunk)
    ties = ["".join(rng.choice("ab ▁\n中") for _ in range(700)), "a" * 500, "ab▁c " * 200]
    rows = [(i, t, "x") for i, t in enumerate([*texts_of(spark, 10), *ties, None])] + [(7, "twice " * 50, "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("IDS", F.lit(1))
    encoder = pc.Encoder(vocabulary)
    got = pc.encode(docs, piece_model(), ids_col="ids", chunk=chunk, group=group).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == encoder([r.text or ""])[0].tolist()


def test_matrices_are_associative(vocabulary):
    text = vocabulary.spelling("the quick brown fox jumps  over the lazy dog " * 6)
    whole = vocabulary.matrix(text, len(text))
    for cut in (16, 37, 100):
        left, right = vocabulary.matrix(text, cut), vocabulary.matrix(text[cut:], len(text) - cut)
        assert np.array_equal(pc.product(left, right)[:, 0], whole[:, 0])


def test_decoding_a_table(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, "中 ▁")], "doc_id long, text string")
    back = pc.decode(pc.encode(rows, piece_model()), piece_model())
    assert all(r.decoded == r.text for r in back.collect())
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pc.decode(none, piece_model()).collect()] == [None, ""]


@pytest.mark.parametrize("ids", [[], [0], [1, 255, 256, 65535, 65536, (1 << 32) - 1] * 300, list(range(200, 3000))])
def test_codes_are_addressable(ids):
    levels, bitmaps, ranks = tf.pack(np.array(ids, np.uint32))
    assert tf.unpack(len(ids), levels, bitmaps).tolist() == ids
    assert [tf.id_at(k, levels, bitmaps, ranks) for k in range(len(ids))] == ids


def test_files_hold_the_librarys_ids_in_order(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = texts_of(spark, 80)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, None), (5, "b"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = scratch_path(spark, "tokens")
    with open(path, encoding="utf-8") as file:
        tf.write_segments(docs, word_encoder(file.read(), end_id=1), out, partitions=4, segment_ids=500)
    segments = tf.read_segments(spark, out)
    assert segments.count() > 8
    start = 0
    for r in tf.documents_of(segments).orderBy("start").collect():
        assert r.start == start
        start += r.n_tokens
    got = {r.doc_id: r for r in tf.documents_of(segments).collect() if r.doc_id != 5}
    order = [r.doc_id for r in tf.documents_of(segments).orderBy("start").collect()]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    for i, text in rows[:-3]:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), crc)


def test_no_documents_no_tokens(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = scratch_path(spark, "tokens")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tf.write_segments(docs, word_encoder(file.read()), out)
    assert tf.documents_of(tf.read_segments(spark, out)).count() == 0


@pytest.mark.parametrize("remembered", [0, 40, 10**6])
def test_pieces_that_were_forgotten_are_encoded_again(remembered, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", remembered)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        contents = file.read()
    library, rng = Tokenizer.from_str(contents), random.Random(remembered)
    letters = "abcé Z1'.-"
    for _ in range(3):  # the second and third encoder take over what the first has learned
        encode = word_bpe.word_encoder(contents, end_id=1)()
        for _ in range(10):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(20)] + ODD
            got = [list(x) for x in encode(texts)]
            assert got == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


LONG = "Full sentences, one after the other, with commas. " * 5
HINTED = {
    "<article><header class='entry-header'><h1>Head</h1></header><p>Text.</p></article>": "Head\nText.",
    "<body><header class='entry-header'><nav>Menu</nav></header><div><h2 class='section-header'>A</h2><p>Some, text.</p></div></body>": "A\nSome, text.",
    "<main><h3 class='header-anchor'>A</h3><p>Text.</p></main>": "A\nText.",
    "<article><p>One.</p><section id='related-work'><h2>Related</h2><p>Text.</p></section></article>": "One.\nRelated\nText.",
    "<article><p>One.</p><section id='search'><p>Text.</p></section></article>": "One.\nText.",
    f"<body><div><p>{LONG}</p><section id='social-history'><p>{LONG}</p></section></div></body>": f"{LONG.strip()}\n{LONG.strip()}",
    "<article><p>One.</p><table class='data-widget'><tr><td>c</td></tr></table></article>": "One.\nc",
    f"<body><div><p>{LONG}</p><div class='share'><a href=x>Mail, this</a></div><div class='left-sidebar'>Side, text.</div></div></body>": LONG.strip(),
    f"<article><p>{LONG}</p><div class='related'><a href=x>Another, one</a> <a href=y>More</a></div></article>": LONG.strip(),
    f"<article><p>{LONG}</p><p class='ad'>Buy, now.</p></article>": LONG.strip(),
    "<b title='x>y</b> <p>z": "y\nz",
}


@pytest.mark.parametrize("page", HINTED)
def test_names_that_articles_have_too(page):
    assert main_text(page) == HINTED[page]


@pytest.mark.parametrize("part", ["<div>x", "<b ", '<b ">', "</i>", "<div class=ad>y", "<p>", "<td>q", "<a href=x>z", "<!-- ", "<script>", "<i><div>"])
def test_odd_pages_take_time_in_proportion(part):
    before = "<i><div>" + "<b>" * 20_000
    start = time.process_time()
    main_text(before + part * (1_000_000 // len(part)))
    assert time.process_time() - start < 30


def path_sums(page):
    """(text, marks, linked, pieces) per path of containers, from paths spelled out."""
    tree = html_text._read(page)
    spelled = [()]
    for k in range(1, len(tree.above)):
        spelled.append((*spelled[tree.above[k]], k))
    out = {}
    for _, path, text, link in html_text._shown(tree):
        full = spelled[path]
        while full and tree.tags[full[-1]] in html_text.TEXTUAL:
            full = full[:-1]
        size = len(text.strip())
        if size:
            old = out.get(full, (0, 0, 0, 0))
            title = any(tree.tags[k] == "h1" for k in spelled[path])
            out[full] = tuple(map(sum, zip(old, (size, len(html_text.PUNCTUATION.findall(text)), size if link and not title else 0, 1), strict=True)))
    return tree, out


def test_ratios_equal_those_of_spelled_out_paths(spark):
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()]
    for page in [*pages, *NAMED, *SPLIT, *HINTED]:
        tree, sums = path_sums(page)
        ratio = {p: min((n - linked) / k, html_text.MOST_TEXT) * (1 + min(marks / k, html_text.MOST_MARKS)) for p, (n, marks, linked, k) in sums.items()}
        smooth = {}
        for p, (n, _, linked, _) in sums.items():
            # The best of all paths, halved by each step up and down that lies between.
            best = 0.0
            for q, r in ratio.items():
                same = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
                best = max(best, r / 2 ** (len(p) + len(q) - 2 * same))
            told = bool(p) and tree.told[p[-1]]
            smooth[p] = best * (1 - linked / n) * (html_text.ARTICLE_WEIGHT if told else 1)
        least = max(smooth.values(), default=0.0) * html_text.THRESHOLD
        want = sorted(p[-1] if p else 0 for p, x in smooth.items() if x >= least)
        assert sorted(html_text._content(tree, html_text._shown(tree))) == want


def test_chunks_of_a_giant_text_run_in_many_tasks(spark, monkeypatch):
    tasks = {}

    def spy(df, name, write=pc.written):
        if name in ("matrices", "origins", "chunk-ids"):
            tasks[name] = df.rdd.getNumPartitions()
        return write(df, name)

    monkeypatch.setattr(pc, "written", spy)
    text = "".join(random.Random(3).choice(["ab", " the", "é", "xy z", "."]) for _ in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    ids = pc.encode(docs, piece_model(), chunk=150).first().ids
    assert tasks == {"matrices": 8, "origins": 8, "chunk-ids": 8}
    assert ids == pc.encode(docs, piece_model()).first().ids
