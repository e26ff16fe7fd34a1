"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import byte_bpe, collocations, decontaminate, html_text, importance, language_id, license_scan, near_dedup, ngram_lm, piece_codec, quality_rules, token_files, url_filter
from gapline.llm.frames import crc_remainder
from gapline.llm.word_bpe import word_encoder
from gapline.sources.scratch import scratch_path, written

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.train(documents.where(~held_out))
    found = language_id.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # Without its text a document is a few numbers: read the texts once.
    features = written(quality_rules.document_features(documents).drop("text"), "features")
    judged = quality_rules.with_verdicts(features, quality_rules.host_verdicts(features))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_near_dedup(spark, sf_dir):
    found = near_dedup.find_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_license_scan(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(documents).drop("text")


def op5_decontaminate(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(documents, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_ngram_lm(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score_documents(documents, crc_remainder("doc_id", 10) != 0)


def piece_model(path: str | None = None) -> bytes:
    """A SentencePiece model file; by default that of the public tokenizers."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op7_piece_codec(spark, sf_dir, model: str | None = None):
    vocabulary = piece_model(model)
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = piece_codec.decode(piece_codec.encode(documents, vocabulary), vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op8_token_files(spark, sf_dir, tokenizer: str | None = None):
    """``tokenizer``: path of the vocabulary file; by default that of the public tokenizers."""
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = word_encoder(file.read(), end_id=1)
    path = scratch_path(spark, "tokens")
    token_files.write_segments(_table(spark, sf_dir, "documents").select("doc_id", "text"), encoder, path)
    return token_files.documents_of(token_files.read_segments(spark, path))


def op9_html_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filter.rule_table(spark, URL_RULES)
    judged = url_filter.filter_urls(pages, rules, spread_by=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def byte_ranks(path: str | None = None) -> bytes:
    """A rank file; by default that of the public tokenizers."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def op11_byte_bpe(spark, sf_dir, ranks: str | None = None):
    import public_tokenizers

    vocabulary, pattern = byte_ranks(ranks), public_tokenizers.PATTERN
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.decode(byte_bpe.encode(documents, vocabulary, pattern).drop("text"), vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_collocations(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.mine_phrases(documents)


def op13_importance(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(documents, _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_rules": op2_quality_rules,
        "op3_near_dedup": op3_near_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_decontaminate": op5_decontaminate,
        "op6_ngram_lm": op6_ngram_lm,
        "op7_piece_codec": op7_piece_codec,
        "op8_token_files": op8_token_files,
        "op9_html_text": op9_html_text,
        "op10_url_filter": op10_url_filter,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_collocations": op12_collocations,
        "op13_importance": op13_importance,
    }


def _url_sql() -> str:
    rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH rules(verdict, host, path) AS (VALUES {rules}),
             parts AS (SELECT page_id, url,
                       translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{upper}', '{lower}') AS host,
                       coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
                       FROM pages),
             fits AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                      row_number() OVER (PARTITION BY p.page_id
                                         ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
                      FROM parts p JOIN rules r
                      ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (page_id)"""


_QUALITY_SQL = r"""
    WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
         words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
         placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words),
         grams AS (SELECT doc_id, k, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS g
                   FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
         twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL),
         covered AS (SELECT DISTINCT doc_id, k + s AS k FROM twice, (VALUES (0), (1), (2)) AS t(s) WHERE n > 1),
         repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
         lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
         worded AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM lines
                    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
         base AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                         coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                         coalesce(n_repeat_words, 0) AS n_repeat_words
                  FROM docs JOIN words USING (doc_id) LEFT JOIN worded USING (doc_id) LEFT JOIN repeats USING (doc_id)),
         judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
         fails AS (SELECT doc_id, source, r.name, r.failed FROM judged, LATERAL (VALUES
                       ('short', n_words < 50), ('repeats', 100 * n_repeat_words > 50 * n_words),
                       ('symbols', 10 * n_symbols > 5 * word_chars), ('dup', 100 * n_dup_lines > 50 * n_lines),
                       ('any', n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 5 * word_chars
                               OR 100 * n_dup_lines > 50 * n_lines)) AS r(name, failed)
                   WHERE source IS NOT NULL),
         rates AS (SELECT source, name, count(*) AS n, avg(failed::INT::DOUBLE) AS rate FROM fails GROUP BY source, name),
         moments AS (SELECT name, avg(rate) AS mean, var_pop(rate) AS spread, avg(1.0::DOUBLE / n) AS noise FROM rates GROUP BY name),
         priors AS (SELECT name, mean, CASE WHEN spread - mean * (1 - mean) * noise > 0
                               THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1, 1), 1e9)
                               ELSE 1e9 END AS strength FROM moments),
         limits AS (SELECT *, least(greatest(mean + 2 * sqrt(mean * (1 - mean) / (strength + 1)), 0.6), 0.8) AS most FROM priors),
         shrunk AS (SELECT source, most, n + strength AS seen, (rate * n + mean * strength) / (n + strength) AS p
                    FROM rates JOIN limits USING (name)),
         hosts AS (SELECT source, bool_or(p - 2 * sqrt(greatest(p * (1 - p), 0) / (seen + 1)) >= most) AS host_rejected
                   FROM shrunk GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
    FROM judged LEFT JOIN hosts USING (source)"""

_DECONTAMINATE_SQL = r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
                  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
         sizes AS (SELECT DISTINCT size FROM wins),
         grams AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS g
                   FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)),
         found AS (SELECT doc_id, item_id, k, size FROM grams JOIN wins USING (size, g)),
         hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
         named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The last list_reduce is CRC-32 by bytes, with its table made by the eight shifts per entry.
_IMPORTANCE_SQL = rf"""
    WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         items AS (SELECT regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         placed AS (SELECT doc_id, unnest(w) AS word FROM docs),
         aimed AS (SELECT unnest(w) AS word FROM items),
         steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS tab),
         vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM placed UNION ALL SELECT word FROM aimed)),
         bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda k:
                          ('0x' || substr(hex(encode(word)), (2 * k + 1)::INT, 2))::BIGINT) AS b FROM vocabulary),
         hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], b),
                           lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
                    FROM bytes, steps),
         s AS (SELECT bucket, count(*) AS n FROM placed JOIN hashed USING (word) GROUP BY bucket),
         t AS (SELECT bucket, count(*) AS n FROM aimed JOIN hashed USING (word) GROUP BY bucket),
         all_s AS (SELECT coalesce(sum(n), 0)::DOUBLE AS a FROM s), all_t AS (SELECT coalesce(sum(n), 0)::DOUBLE AS b FROM t),
         gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (a + 10000) / ((s.n + 1) * (b + 10000))))::BIGINT AS gain
                   FROM s LEFT JOIN t USING (bucket), all_s, all_t),
         weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM placed JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
         scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                           (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                    FROM docs LEFT JOIN weights USING (doc_id)),
         ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
                    FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)"""


def _nested(size: int) -> str:
    """Phrases of ``size`` words as the words from place k on."""
    return " || ' ' || ".join(f"w[k + {i}]" if i else "w[k]" for i in range(size))


_PHRASES_SQL = rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
         placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM worded),
         totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
         grams AS (SELECT lang, size, phrase, count(*) AS f FROM (
                       {" UNION ALL ".join(f"SELECT lang, {m} AS size, {_nested(m)} AS phrase FROM placed WHERE k + {m - 1} <= len(w)" for m in range(1, 5))})
                   GROUP BY lang, size, phrase),
         candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 30),
         keyed AS (SELECT lang || chr(9) || phrase AS key, f FROM grams),
         cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
         parts AS (SELECT *, lang || chr(9) || array_to_string(w[1:k], ' ') AS first, lang || chr(9) || array_to_string(w[k + 1:], ' ') AS rest FROM cuts),
         scored AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
                    FROM parts c JOIN keyed l ON l.key = c.first JOIN keyed r ON r.key = c.rest),
         lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         longer AS (SELECT lang, array_to_string(w[b : b + s - 1], ' ') AS phrase, max(a) AS a
                    FROM candidates, (VALUES (1), (2), (3)) AS bs(b), (VALUES (2), (3)) AS ss(s)
                    WHERE s < size AND b + s - 1 <= size GROUP BY ALL)
    SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
    FROM (SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.phrase = lowest.phrase
          WHERE longer.a IS NULL OR 100 * longer.a < 80 * lowest.a) JOIN totals USING (lang)
    WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY rank <= 2000"""


def oracle_sql():
    return {
        "op2_quality_rules": _QUALITY_SQL,
        "op5_decontaminate": _DECONTAMINATE_SQL,
        "op10_url_filter": _url_sql(),
        "op12_collocations": _PHRASES_SQL,
        "op13_importance": _IMPORTANCE_SQL,
    }
