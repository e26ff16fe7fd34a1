"""License scans: a positional index of rare licence words, all in DataFrame functions.

Each template (a phrase or a passage of a licence) is looked up by its rare words. How
rare a word is, is counted over the corpus first; a template's postings are its words of
highest IDF with their places. A document is scanned for those words; each hit says where
the template would have to start, the other rare words are checked at their places
relative to that start, and starts with enough of them whose mandatory phrases occur as
well are matches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.frames import LOWER, UPPER, unused_name, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A start is one number: template * SPAN + place, so that sets of starts are hashed.
SPAN = 1 << 40


@dataclass(frozen=True)
class Template:
    """``words`` are looked up; ``needs`` must occur somewhere in the text, ``lacks`` must not (lower case, single spaces).

    ``exact`` templates match only as a whole, others by ``min_share`` of the IDF of their rare words.
    """

    label: str
    words: str
    exact: bool = False
    needs: tuple[str, ...] = field(default=())
    lacks: tuple[str, ...] = field(default=())


# The phrases and labels that are always found.
BASE = (
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
)
# Opening words of public licence texts, and short notices (exact phrases).
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", needs=("without restriction",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", needs=("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", needs=("redistributions of source code",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", needs=("mozilla public license",)),
    Template("lgpl", "gnu lesser general public license as published by the free software foundation", needs=("lesser general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", needs=("with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", needs=("unencumbered software", "public domain")),
    Template("apache-2.0", "apache license version 2 0", exact=True),
    Template("apache-2.0", "apache license 2 0", exact=True),
    Template("apache-2.0", "apache 2 0 license", exact=True),
    Template("mit", "the mit license", exact=True),
    Template("mit", "mit license copyright", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
    Template("cc-by-nc", "creative commons attribution noncommercial", exact=True),
    Template("cc-by-sa", "cc by sa", exact=True),
    Template("cc-by-sa", "creative commons attribution sharealike", exact=True),
    # Passages, several per text.
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", needs=("permission is hereby granted",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", needs=("apache license",)),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", needs=("redistributions of source code", "redistributions in binary form"), lacks=("endorse or promote products",)),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", needs=("redistributions of source code",), lacks=("all advertising materials mentioning",)),
    Template("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", needs=("redistributions of source code",)),
    Template("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", needs=("gnu general public license", "version 2 of the license")),
    Template("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", needs=("gnu general public license", "version 3 of the license")),
    Template("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", needs=("gnu lesser general public license", "version 2 1 of the license")),
    Template("lgpl-3.0", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", needs=("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", needs=("gnu affero general public license", "version 3 of the license")),
    Template("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", needs=("mozilla public license version 1 1",)),
    Template("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", needs=("eclipse public license v1 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", needs=("eclipse public license 2 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", needs=("eclipse public license v2 0",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", needs=("altered source versions",)),
    Template("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", needs=("altered source versions",)),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", needs=("machine executable object code",)),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", needs=("open font license",)),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", needs=("without a written agreement",)),
    Template("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", needs=("openssl project",)),
    # Short notices.
    Template("gpl-2.0", "gnu general public license version 2", exact=True),
    Template("gpl-2.0", "gnu general public license v2", exact=True),
    Template("gpl-3.0", "gnu general public license version 3", exact=True),
    Template("gpl-3.0", "gnu general public license v3", exact=True),
    Template("lgpl-2.1", "gnu lesser general public license version 2 1", exact=True),
    Template("lgpl-3.0", "gnu lesser general public license version 3", exact=True),
    Template("agpl-3.0", "gnu affero general public license version 3", exact=True),
    Template("bsl-1.0", "boost software license version 1 0", exact=True),
    Template("cc0-1.0", "cc0 1 0 universal", exact=True),
    Template("cc-by-nd", "cc by nd", exact=True),
    Template("cc-by-nd", "creative commons attribution noderivatives", exact=True),
    Template("cc-by-nc-sa", "cc by nc sa", exact=True),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", exact=True),
    Template("cc-by-nc-nd", "cc by nc nd", exact=True),
    Template("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", exact=True),
    Template("mpl-2.0", "mozilla public license version 2 0", exact=True),
    Template("artistic-2.0", "artistic license 2 0", exact=True),
    Template("python-2.0", "python software foundation license version 2", exact=True),
    Template("ncsa", "university of illinois ncsa open source license", exact=True),
    Template("ms-pl", "microsoft public license", exact=True),
    Template("cddl", "common development and distribution license", exact=True),
    Template("eupl", "european union public licence", exact=True),
)


def word_array(text: Column) -> Column:
    """Lower-cased words (ASCII letters and digits, all of U+0080 on); none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))


def _document_counts(docs: DataFrame, templates: Sequence[Template], text_col: str) -> dict[str, int]:
    """Documents that hold each of the templates' words; of all documents for the empty word."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    found = F.filter(word_array(F.col(f"`{text_col}`")), lambda w: w.isin(vocabulary))
    counts = docs.select(F.array_distinct(found).alias("words")).withColumn("words", F.array_append("words", F.lit("")))
    rows = counts.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    return dict.fromkeys([*vocabulary, ""], 0) | {r["word"]: r["count"] for r in rows}


def _idf(seen: dict[str, int]) -> dict[str, float]:
    return {w: math.log((1 + seen[""]) / (1 + n)) + 1 for w, n in seen.items() if w}


def word_idf(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[str, float]:
    """IDF of the templates' words over all documents; at most that many rows reach the driver."""
    return _idf(_document_counts(docs, templates, text_col))


def _rare(template: Template, idf: dict[str, float], rare_words: int, absent: frozenset[str]) -> list[tuple[int, str, float]]:
    """The template's words of highest IDF: place, word, IDF; the rarest first, of a passage without absent ones."""
    places = [(k, w, idf[w]) for k, w in enumerate(template.words.split())]
    ranked = sorted(places, key=lambda p: (-p[2], p[0]))
    return ranked if template.exact else [p for p in ranked if p[1] not in absent][:rare_words]


def _possible(template: Template, idf: dict[str, float], absent: frozenset[str], min_share: float) -> bool:
    """Whether words that some document holds have ``min_share`` of the template's joint IDF."""
    own = template.words.split()
    there = sum(idf[w] for w in own if w not in absent)
    return there > 0 and there >= min_share * sum(idf[w] for w in own)


def _literal_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*(c for k, v in entries.items() for c in (F.lit(k), v)))


def scan_licenses(
    docs: DataFrame,
    base: Sequence[Template] = BASE,
    templates: Sequence[Template] = PASSAGES,
    text_col: str = "text",
    rare_words: int = 5,
    min_share: float = 0.8,
    idf: dict[str, float] | None = None,
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to ``docs``.

    ``n_base`` counts all places of ``base`` phrases, ``first_word`` and ``last_word`` are the
    smallest and largest (words counted from 0; null without any). ``labels`` also has those of
    ``templates``: a passage matches where rare words with ``min_share`` of their joint IDF stand
    in the right places, all its mandatory phrases occur, and none that it must lack. Words that no document holds are not
    among its rare words; a passage with too little IDF without them matches nowhere. With a given
    ``idf`` all words count as held. ``score`` is the largest such share (1 for a whole phrase, 0 without a match). Null and empty texts have no words. Repeated rows
    stay; columns of these seven names are replaced. No row leaves its partition; the only shuffle
    is that of the word counts behind ``idf``.
    """
    every = [*base, *templates]
    if not any(t.words.split() for t in every):
        raise ValueError("no template has a word")
    absent: frozenset[str] = frozenset()
    if not idf:
        seen = _document_counts(docs, every, text_col)
        idf, absent = _idf(seen), frozenset(w for w, n in seen.items() if not n)
    # An exact phrase with an absent word matches nowhere.
    live = [[t for t in ts if (absent.isdisjoint(t.words.split()) if t.exact else _possible(t, idf, absent, min_share))] for ts in (base, templates)]
    if any(live):
        base, every = live[0], [*live[0], *live[1]]
    else:
        absent = frozenset()
    rare = [_rare(t, idf, rare_words, absent) for t in every]
    # An exact phrase needs its rarest word alone; a passage may lack some of its words.
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, (template, ranked) in enumerate(zip(every, rare, strict=True)):
        for place, word, _ in ranked[:1] if template.exact else ranked:
            postings.setdefault(word, []).append((n, place))
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = without(docs.columns, results)
    words, starts, shares = (unused_name(c, docs.columns) for c in ("_words", "_starts", "_shares"))
    index = _literal_map(
        {w: F.array(*(F.struct(F.lit(n * SPAN).alias("of"), F.lit(k).alias("place")) for n, k in at)) for w, at in postings.items()}
    )
    docs = docs.withColumn(words, word_array(F.col(f"`{text_col}`")))
    hits = F.filter(
        F.transform(words, lambda w, k: F.when(w.isin(list(postings)), F.struct(w.alias("w"), k.cast("long").alias("k")))),
        lambda h: h.isNotNull(),
    )
    begun = F.flatten(
        F.transform(hits, lambda h: F.transform(
            F.filter(index[h["w"]], lambda p: p["place"] <= h["k"]), lambda p: p["of"] + h["k"] - p["place"]))
    )
    docs = docs.withColumn(starts, F.array_distinct(begun))

    def share(n: int, at: Column) -> Column:
        """Of the IDF of the template's rare words, the share that stands in its place."""
        total = sum(weight for _, _, weight in rare[n])
        there = [
            F.when(F.get(F.col(words), (at + place).cast("int")) == word, F.lit(weight)).otherwise(F.lit(0.0))
            for place, word, weight in rare[n]
        ]
        if every[n].exact:  # no rounding
            whole = reduce(lambda a, b: a & b, (t > 0 for t in there))
            return F.when(whole, F.lit(1.0)).otherwise(F.lit(0.0))
        return reduce(lambda a, b: a + b, there) / F.lit(total)

    def judged(start: Column) -> Column:
        n, at = F.floor(start / SPAN), F.pmod(start, F.lit(SPAN))
        found = F.lit(0.0)
        for k in reversed(range(len(every))):
            found = F.when(n == k, share(k, at)).otherwise(found)
        return F.struct(n.alias("n"), at.alias("at"), found.alias("share"))

    docs = docs.withColumn(shares, F.filter(F.transform(starts, judged), lambda s: s["share"] >= F.lit(min_share)))
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    allowed = F.array_compact(F.array(*(
        F.when(reduce(lambda a, b: a & b, (*(spaced.contains(f" {p} ") for p in t.needs), *(~spaced.contains(f" {p} ") for p in t.lacks)), F.lit(True)), F.lit(n))
        for n, t in enumerate(every)
    )))
    some = F.size(shares) > 0
    docs = docs.withColumn(shares, F.when(some, F.filter(shares, lambda s: F.array_contains(allowed, s["n"]))).otherwise(F.col(shares)))
    at_base = F.transform(F.filter(shares, lambda s: s["n"] < len(base)), lambda s: s["at"])
    names = F.array(*(F.lit(t.label) for t in every))

    def labels(of: Column) -> Column:
        found = F.transform(of, lambda s: F.get(names, s["n"].cast("int")))
        return F.array_join(F.array_sort(F.array_distinct(found)), ",")

    return docs.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size(words).cast("long").alias("n_words"),
        F.size(at_base).cast("long").alias("n_base"),
        F.array_min(at_base).alias("first_word"),
        F.array_max(at_base).alias("last_word"),
        labels(F.filter(shares, lambda s: s["n"] < len(base))).alias("base_labels"),
        labels(F.col(shares)).alias("labels"),
        F.coalesce(F.array_max(F.transform(shares, lambda s: F.least(s["share"], F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
