"""Quality rules, licence scans, decontamination and URL filters against plain Python."""

import plain_text
import pytest
from gapline.llm import decontaminate as dc
from gapline.llm import license_scan, quality_rules, url_filter
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

WORDS = ["a", "bb", "The", "né", "x1", "#", "|", "中文", "e\u0301"]
texts = st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), max_size=6).map("\n".join)
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def make(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


@few
@given(st.lists(st.none() | texts, min_size=1, max_size=40))
def test_features_are_those_of_plain_python(spark, found):
    rows = [(i, t, "s", "old", 1) for i, t in enumerate(found)]
    docs = make(spark, rows, "doc_id long, text string, source string, Other string, n_words int")
    got = quality_rules.document_features(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: r[k] for k in quality_rules.FEATURES} == plain_text.quality(found[r.doc_id])
        assert r.Other == "old"


def test_long_texts_are_cut_for_hashing_only(spark):
    line = "x" * 3_000_000
    text = f"{line}\n{line}\n" + "ab cd ef " * 300_000
    got = quality_rules.document_features(make(spark, [(1, text, "s"), (2, "", "s")])).where("doc_id = 1").first()
    assert (got.n_dup_lines, got.n_words, got.n_repeat_words) == (1, 900_002, 900_000)


def good(n):
    return " ".join(f"w{n}x{k}" for k in range(60))


def test_a_bad_host_takes_its_documents(spark):
    rows = [(i, "too short", "bad") for i in range(400)] + [(1000, good(0), "bad"), (1001, good(1), None), (1002, "short", None)]
    rows += [(2000 + i, good(i) if i % 10 else "x", f"host{i % 7}") for i in range(210)]
    judged = {r.doc_id: r for r in quality_rules.judge(make(spark, rows)).collect()}
    assert len(judged) == len(rows)
    assert judged[1000].host_rejected and not judged[1000].base_failed and not judged[1000].kept
    assert judged[1001].kept and not judged[1002].kept
    others = [r for r in judged.values() if r.doc_id >= 2000]
    assert not any(r.host_rejected for r in others)
    assert all(r.kept == (not plain_text.base_failed(r.text)) for r in others)


def test_small_hosts_are_shrunk(spark):
    rows = [(i, good(i), f"h{i % 20}") for i in range(400)] + [(999, "one short document", "single")]
    hosts = {r.host: r for r in quality_rules.host_verdicts(quality_rules.document_features(make(spark, rows))).collect()}
    assert not hosts["single"].host_rejected and hosts["single"].shrunk_short < 0.9


def hosts_of(bad, documents, other=20):
    """A host of which ``bad`` in a hundred documents are short or repeat lines, and 20 hosts with one bad in ten."""
    noisy = "\n".join(["# " * 40 + "word"] * 3)
    rows = [(i, (("x", noisy)[i % 2] if i * 100 < bad * documents else good(i)), "worst") for i in range(documents)]
    return rows + [(10_000 + i, good(i) if i % 10 else "x", f"host{i // other}") for i in range(20 * other)]


@pytest.mark.parametrize(("bad", "documents", "falls"), [(85, 400, True), (95, 60, True), (85, 4, False), (100, 1, False), (50, 400, False), (30, 400, False)])
def test_a_host_falls_if_it_is_surely_bad(spark, bad, documents, falls):
    judged = quality_rules.judge(make(spark, hosts_of(bad, documents))).collect()
    assert {r.source for r in judged if r.host_rejected} == ({"worst"} if falls else set())
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in judged)


def test_rules_are_taken_together(spark):
    rows = hosts_of(85, 400)
    hosts = quality_rules.host_verdicts(quality_rules.document_features(make(spark, rows)))
    worst = hosts.where("host = 'worst'").first()
    assert worst.host_rejected and max(worst.shrunk_short, worst.shrunk_repeats) < 0.6 < worst.shrunk_any_rule
    again = quality_rules.host_verdicts(quality_rules.document_features(make(spark, [(i, t, None) for i, t, _ in rows])))
    assert again.count() == 0


@pytest.mark.parametrize("documents", [400, 4])
def test_verdicts_of_bad_hosts_equal_sql(spark, documents):
    import duckdb
    import pandas as pd
    from gapline.llm.queries import oracle_sql

    rows = hosts_of(85, documents)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = dict(con.sql(f"SELECT doc_id, kept FROM ({oracle_sql()['op2_quality_rules']})").fetchall())
    assert {r.doc_id: r.kept for r in quality_rules.judge(make(spark, rows)).collect()} == want


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", None)] * 3])
def test_rules_on_nothing(spark, rows):
    got = quality_rules.judge(make(spark, rows)).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got)
    assert len(license_scan.scan_licenses(make(spark, rows)).collect()) == len(rows)
    items = spark.createDataFrame([], "item_id long, text string")
    found = dc.find_overlaps(make(spark, rows), items).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in found] == [(0, [], [])] * len(rows)
    assert dc.decontaminate(make(spark, rows), items).count() == len(rows)


LICENCE = [*"cc by general public license all rights reserved CC-BY filler Public".split(), "rights\nreserved"]


@few
@given(st.lists(st.none() | st.lists(st.sampled_from(LICENCE), max_size=30).map(" ".join), min_size=1, max_size=30))
def test_base_phrases_are_those_of_plain_python(spark, found):
    got = license_scan.scan_licenses(make(spark, [(i, t, "s") for i, t in enumerate(found)])).collect()
    wanted = [(t.label, t.words) for t in license_scan.BASE]
    for r in got:
        places = plain_text.phrases(found[r.doc_id], wanted)
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base) == (len(plain_text.alphanumeric(found[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
        labels = sorted({label for _, label in places})
        assert r.base_labels == ",".join(labels) and set(labels) <= set(r.labels.split(",") if r.labels else [])
        assert r.score == 1.0 if labels else 0 <= r.score <= 1


def test_passages_need_their_places_and_phrases(spark):
    mit = license_scan.PASSAGES[0]
    rows = [
        (1, "Intro. " + mit.words.upper() + ", to deal in it without restriction.", ""),
        (2, mit.words, ""),  # the key phrase is missing
        (3, " ".join(reversed(mit.words.split())) + " without restriction", ""),
        (4, mit.words.replace("free", "at no cost") + " without restriction", ""),  # places have moved
    ]
    docs = make(spark, rows).withColumnRenamed("source", "LABELS")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[1].labels == "mit" and got[1].score == pytest.approx(1.0) and got[1].base_labels == ""
    assert [got[k].labels for k in (2, 3)] == ["", ""]


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.': "apache-2.0",
    "SPDX: Apache 2.0 license": "apache-2.0",
    "Released under the MIT License.": "mit",
    "The MIT License (MIT)\n\nCopyright (c) 2024": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation; either version 2 of the License, or": "gpl,gpl-2.0",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License": "gpl,lgpl,lgpl-2.1",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License": "agpl-3.0,gpl",
    "are made available under the terms of the Eclipse Public License v1.0, as this program and the accompanying materials are": "",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain\n2. Redistributions in binary form must reproduce": "bsd,bsd-2-clause",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must; Redistributions in binary form must; Neither the name of X nor its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd,bsd-3-clause",
    "Geschrieben mit license plates, released under the bridge by nc 4": "",
}


def test_real_notices_are_labelled(spark):
    rows = [(k, f"Some words. {n}\nMore words of the text.", "") for k, n in enumerate(NOTICES)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(make(spark, rows)).collect()}
    assert got == dict(enumerate(NOTICES.values()))


TEMPLATES = (
    license_scan.Template("long", "t1 t2 t3 t4 t5 t6", needs=("key one",)),
    license_scan.Template("other", "t4 t5 t9 t2 t7 t7", lacks=("key two",)),
    license_scan.Template("whole", "t2 t3 t4", exact=True),
    license_scan.Template("whole", "t8 nowhere", exact=True),
    license_scan.Template("absent", "t1 nowhere never t2"),
)


def plain_matches(text, templates, idf, absent, rare_words, min_share):
    """(labels, largest share) by trying every start of every template."""
    words = plain_text.alphanumeric(text)
    spaced, found = f" {' '.join(words)} ", {}
    for t in templates:
        own = t.words.split()
        if any(f" {p} " not in spaced for p in t.needs) or any(f" {p} " in spaced for p in t.lacks):
            continue
        if t.exact:
            shares = [float(words[k : k + len(own)] == own) for k in range(len(words))]
        else:
            if sum(idf[w] for w in own if w not in absent) < min_share * sum(idf[w] for w in own):
                continue
            ranked = sorted((-idf[w], k) for k, w in enumerate(own) if w not in absent)[:rare_words]
            total = sum(-x for x, _ in ranked)
            shares = [sum(-x for x, k in ranked if at + k < len(words) and words[at + k] == own[k]) / total for at in range(len(words))]
        best = max(shares, default=0.0)
        if best >= min_share:
            found[t.label] = max(found.get(t.label, 0.0), best)
    return ",".join(sorted(found)), max(found.values(), default=0.0)


pieces = st.sampled_from([t.words for t in TEMPLATES[:3]] + ["key one", "key two", "T1 t2, t3 x t5 t6", "t4 t5 x t2 t7 t7", "t8", "-"])


@few
@given(st.lists(st.none() | st.lists(pieces, max_size=8).map(" ".join), min_size=1, max_size=25), st.sampled_from([2, 5]), st.sampled_from([0.55, 0.77]))
def test_labels_and_scores_are_those_of_plain_python(spark, found, rare_words, min_share):
    import math

    got = license_scan.scan_licenses(make(spark, [(i, t, "s") for i, t in enumerate(found)]), [], TEMPLATES, rare_words=rare_words, min_share=min_share).collect()
    held = [set(plain_text.alphanumeric(t)) for t in found]
    counts = {w: sum(w in h for h in held) for t in TEMPLATES for w in t.words.split()}
    idf = {w: math.log((1 + len(found)) / (1 + n)) + 1 for w, n in counts.items()}
    absent = {w for w, n in counts.items() if not n}
    for r in got:
        labels, score = plain_matches(found[r.doc_id], TEMPLATES, idf, absent, rare_words, min_share)
        assert r.labels == labels and r.score == pytest.approx(score), (found[r.doc_id], idf)


def test_words_of_no_document_are_not_looked_up(spark):
    passage = license_scan.Template("own", "alpha beta gamma delta epsilon zeta eta theta iota kappa")
    near = passage.words.replace("delta", "other")
    rows = [(1, "so " + near, ""), (2, "alpha kappa", ""), (3, "gamma", "")]
    # The one word of highest IDF is in no document.
    got = license_scan.scan_licenses(make(spark, rows), templates=[passage], rare_words=1).orderBy("doc_id").collect()
    assert [r.labels for r in got][0] == "own"
    lost = license_scan.Template("lost", "alpha u1 u2 u3 u4")
    got = license_scan.scan_licenses(make(spark, rows), base=[], templates=[lost]).collect()
    assert [r.labels for r in got] == ["", "", ""]


STEPS = [f"w{k}" for k in range(6)]


@few
@given(
    st.lists(st.lists(st.sampled_from(STEPS), max_size=60).map(" ".join), min_size=1, max_size=20),
    st.lists(st.lists(st.sampled_from(STEPS), max_size=16).map(" ".join), min_size=1, max_size=8),
    st.sampled_from([1, 30, 10_000]),
)
def test_overlaps_are_those_of_plain_python(spark, found, items, block_words):
    items = list(enumerate(items))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_overlaps(make(spark, [(i, t, "s") for i, t in enumerate(found)]), table, block_words=block_words, window=4).collect()
    for r in got:
        hit, names = plain_text.overlaps(found[r.doc_id], items, window=4)
        spans = [k for s in r.spans for k in range(s.first, s.after)]
        assert (r.n_words, sorted(spans), r["items"]) == (len(found[r.doc_id].split()), sorted(hit), names)


def test_passages_are_cut_and_covered_texts_left_out(spark):
    item = " ".join(f"item{k}" for k in range(12))
    items = spark.createDataFrame([(7, item.upper()), (None, "clean text"), (8, None)], "item_id long, text string")
    text = good(1) + ". Before, " + item.replace(" ", ", ") + "; after. " + good(2)
    rows = [(1, text, "spans"), (2, item + " tail", "s"), (3, good(3), None), (4, text, "spans")]
    docs = make(spark, rows).withColumnRenamed("source", "items")
    got = {r.doc_id: r for r in dc.decontaminate(docs, items).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].asDict().keys() == {"doc_id", "text", "items"}
    assert got[1].text == got[4].text == good(1) + ". Before, ; after. " + good(2) and got[3].text == good(3)


HOSTS = ["com", "example.com", "a.example.com", "xexample.com", "net", "EXAMPLE.com", "", "b.net"]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/english?x=/en/", "#/en/", "/fr/é"]
urls = st.none() | st.builds(lambda s, h, p: s + h + p, st.sampled_from(["http://", "", "x://"]), st.sampled_from(HOSTS), st.sampled_from(PATHS))
rule = st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from([h.lower() for h in HOSTS if h]), st.sampled_from(["", "/", "/en", "/en/", "/fr/é"]))


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate(plain_text.UPPER), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


@few
@given(st.lists(urls, min_size=1, max_size=60), st.dictionaries(st.tuples(st.sampled_from(["com", "example.com", "net"]), st.sampled_from(["", "/", "/en", "/en/"])), st.sampled_from(["allow", "block"]), max_size=6))
def test_urls_are_judged_as_by_plain_python(spark, found, rules):
    rules = [(verdict, *where) for where, verdict in rules.items()]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(found)], "page_id long, url string, _row string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), spread_by=["page_id"], buckets=3).collect()
    assert len(got) == len(found)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(found[r.page_id], rules)
        assert r._row == "x"


def test_no_python_in_native_plans(spark):
    docs = make(spark, [(1, "all rights reserved", "s")])
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("block", "com", "/")])
    for df in (license_scan.scan_licenses(docs), url_filter.filter_urls(pages, rules)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
