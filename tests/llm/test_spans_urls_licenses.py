import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartweave.llm import licenses, spans, urls


def brute_pieces(text):
    """The cutting rule with places of cuts: sentence ends, then commas, then the least word of every window."""
    def pieces(t, ends):
        cuts = sorted({0, len(t), *ends})
        return [t[a:b] for a, b in zip(cuts, cuts[1:])]

    out = []
    for sentence in pieces(text, [m.end() for m in re.finditer(r"[.!?]+[\"')\]»”]*\s+|\s*\n\s*", text)]):
        long = len(sentence.split()) >= 16
        for clause in pieces(sentence, [m.end() for m in re.finditer(r"[,;:]\s+", sentence)] if long else []):
            words = list(re.finditer(r"\S+\s*", clause))
            sums = [zlib.crc32(w[0].strip().lower().encode()) for w in words]
            windows = range(len(words) - 11) if long and len(words) >= 16 else ()
            out += pieces(clause, {words[k].end() for i in windows for k in range(i, i + 12) if sums[k] == min(sums[i : i + 12])})
    return out


def brute_spans(rows, least, words, alone):
    """Every repeated run of ``least`` sentences and ``words`` words (or one sentence of ``alone``), of any length.

    Runs grow by a sentence at a time; one that is not repeated has no repeated longer one.
    """
    docs = sorted({(d is None, d or 0, t or "") for d, t, *_ in rows})
    cut = [[tuple(x.encode().lower().split()) for x in brute_pieces(t)] for _, _, t in docs]
    runs = [(0, 0, n, at) for n, p in enumerate(cut) for at in range(len(p))]
    gone, size = {}, 0
    while runs:
        size += 1
        groups = {}
        for run, n_words, n, at in runs:
            if at + size <= len(cut[n]):
                piece = cut[n][at + size - 1]
                groups.setdefault((run, piece), []).append((n, at, n_words + len(piece)))
        runs = []
        for number, held in enumerate(h for h in groups.values() if len(h) > 1):
            runs += [(number, n_words, n, at) for n, at, n_words in held]
            if (size == 1 and held[0][2] >= alone) or (size >= least and held[0][2] >= words):
                for n, at, _ in sorted(held)[1:]:
                    gone.setdefault(n, set()).update(range(at, at + size))
    out = Counter()
    for d, t, *_ in rows:
        n = docs.index((d is None, d or 0, t or ""))
        pieces, lost = spans.sentences(t), gone.get(n, set())
        runs = sum(1 for i in lost if i - 1 not in lost)
        out[d, len(pieces), len(lost), runs, "".join(p for i, p in enumerate(pieces) if i not in lost)] += 1
    return out


PASSAGE = "One two three four five. Six seven eight! Nine ten eleven? "


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, at string, n string")


def _got(df):
    return Counter((r.doc_id, r.n_sentences, r.n_removed, r.n_spans, r.text) for r in df.collect())


def test_spans_equal_brute_force(spark):
    rows = [
        (3, f"Own start. {PASSAGE}Own end.", None, "x"), (1, f"Another text here. {PASSAGE}", None, None), (2, PASSAGE * 2, None, None),
        (None, f"mid {PASSAGE.upper()}", None, None), (5, None, None, None), (6, "", None, None), (7, "A. B. C. D. E. F. G. H. " * 3, None, None),
        (8, "long " * 60, None, None), (9, "Head.\n" + "long " * 60 + "\nTail.", None, None), (10, "w. " * 300 + PASSAGE, None, None), (13, "w " * 200, None, None),
        (2, PASSAGE * 2, None, None), (11, "\n\n \n", None, None), (12, "no end", None, None),
    ]
    got = _got(spans.dedup_spans(_docs(spark, rows), 2, 6, 40))
    assert got == brute_spans(rows, 2, 6, 40)
    assert [k[2] for k in got if k[0] == 1] == [0] and [k[2] for k in got if k[0] == 3] == [3]
    assert spans.dedup_spans(_docs(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab.!?, \n\"", max_size=120), st.lists(st.sampled_from(["a", "b", "cc", "d,", "e."]), max_size=60))
def test_pieces_make_the_text(text, words):
    assert "".join(spans.sentences(text)) == text and all(spans.sentences(text))
    for t in (text, " ".join(words)):
        assert spans.sentences(t) == brute_pieces(t)


def test_tail_of_a_longer_repeated_run_goes(spark):
    pieces = ["a" + " w" * 14 + ". ", "b" + " w" * 14 + ". ", "c d e f. "]
    rows = [(1, "".join(pieces) + "Other end.", None, None), (2, "Start. " + "".join(pieces) + "And more here.", None, None)]
    assert {r.doc_id: r.n_removed for r in spans.dedup_spans(_docs(spark, rows)).collect()} == {1: 0, 2: 3}


def test_passages_are_caught_wherever_they_are_set():
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    rng, caught, made = random.Random(5), 0, 0
    for text in texts:
        words = text.split(" ")
        if len(words) < 130 or len(set(words)) < 25:
            continue
        at = rng.randrange(len(words) - 55)
        passage = " ".join(words[at : at + 51])
        held = []
        for _ in range(2):
            other = rng.choice(texts).split(" ")
            cut = rng.randrange(len(other))
            pieces = spans.sentences(" ".join([*other[:cut], passage, *other[cut:]]))
            held.append((pieces, spans.spans(pieces)))
        known = {bytes(key) for _, _, key in held[0][1]}
        gone = {i for at, n, key in held[1][1] if bytes(key) in known for i in range(at, at + n)}
        made += 1
        caught += sum(len(held[1][0][i].split()) for i in gone) >= 26
    assert made > 300 and caught >= 0.99 * made, (caught, made)


def test_passage_inside_other_sentences_is_caught(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(55)), " ".join(word() + ("," if i % 9 == 8 else "") for i in range(55))]
    rows = []
    for n, passage in enumerate(passages):
        for k in range(3):
            rows.append((10 * n + k, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30)) + ".", None, None))
    got = {r.doc_id: r.n_removed for r in spans.dedup_spans(_docs(spark, rows)).collect()}
    assert {d for d, n in got.items() if n} == {1, 2, 11, 12}


def test_span_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = _got(entry.queries()["op7_substring_dedup"](spark, folder))
    assert got == brute_spans(rows, spans.SENTENCES, spans.WORDS, spans.ALONE) and any(k[2] for k in got)


def brute_accepts(markup_words, words):
    """``markup_words``: nested lists are optional, tuples (test, least, most) replaceable, words mandatory."""
    def ends(parts, at):
        here = {at}
        for p in parts:
            if isinstance(p, str):
                here = {i + 1 for i in here if i < len(words) and words[i] == p}
            elif isinstance(p, list):
                here |= {e for i in here for e in ends(p, i)}
            else:
                test, least, most = p
                here = {i + n for i in here for n in range(least, most + 1) if i + n <= len(words) and all(w in test for w in words[i : i + n])}
        return here
    return any(ends(markup_words, at) for at in range(len(words) + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9))
def test_automaton_equals_brute_force(words):
    markup = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;name="v";match="[bc]";words="1..2">> d'
    parts = ["a", ["b", ["c"], "d"], ("bc", 1, 2), "d"]
    automaton = licenses.compile_template(markup)
    assert automaton.accepts([w.encode() for w in words]) == brute_accepts(parts, words)
    optional = licenses.compile_template('<<var;name="v";match="[ab]";words="0..2">> c <<beginOptional>>d<<endOptional>>')
    assert optional.accepts([w.encode() for w in words]) == brute_accepts([("ab", 0, 2), "c", ["d"]], words)


def test_automaton_wording_and_faults():
    assert licenses.compile_template('x y <<var;name="v";match=".";words="1..1">> long wording here <<beginOptional>>a b c d e<<endOptional>> z').wording == b"long wording here"
    for bad in ("a <<beginOptional>> b", "a <<what>> b"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


_GNU = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
LICENCES = [
    (_GNU.format("Affero "), "header:agpl", "redistribute"), (_GNU.format(""), "header:gpl", "modify"), (_GNU.format("Lesser "), "header:lgpl", "published"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "header:apache-2.0,notice:apache-2.0", "apache"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http", "header:mpl-2.0", "subject"),
    ("To the extent possible under law, Ann of Example has waived all copyright and related or neighboring rights to it", "notice:cc0", "waived"),
    ("a Creative Commons Attribution 4.0 International License", "notice:creative-commons-by", "attribution"),
    ("a Creative Commons Attribution-ShareAlike 3.0 License", "notice:creative-commons-by-sa", "commons"),
    (_BSD, "text:bsd-2", "retain"),
    (_BSD + " 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "text:bsd-2,text:bsd-3", "reproduce"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "text:isc", "fee"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "text:mit", "merge"),
]


def test_licence_texts_and_altered_ones(spark, tmp_path):
    """Every text has its labels, and none of them with one mandatory word changed; the SQL agrees."""
    import re

    from chartweave.llm.queries import LLM_QUERIES

    rows = [(n, f"Intro. {t} Outro.", None, None) for n, (t, _, _) in enumerate(LICENCES)]
    rows += [(100 + n, re.sub(rf"\b{word}\b", "changed", t, flags=re.I), None, None) for n, (t, _, word) in enumerate(LICENCES)]
    docs = _docs(spark, rows)
    method = {r.doc_id: ",".join(x for x in r.labels.split(",") if ":" in x) for r in licenses.scan(docs).collect()}
    assert method == {n: LICENCES[n][1] if n < 100 else "" for n in method} and len(method) == 2 * len(LICENCES)
    duckdb = pytest.importorskip("duckdb")
    docs.select("doc_id", "text").toPandas().to_parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    cur = con.execute(LLM_QUERIES["op10_license_scan"][1])
    names = [c[0] for c in cur.description]
    want = {r[names.index("doc_id")]: r[names.index("labels")] for r in cur.fetchall()}
    assert want == {r.doc_id: r.labels for r in licenses.scan(docs).collect()}


def test_scan_odd_rows(spark):
    rows = [
        (1, None, None, "x"), (2, "", None, None), (3, "CC-BY cc by CC  BY", None, None), (4, "This work is licensed under the GNU General Public License, version 3.", None, None),
        (5, "Licensed under the Apache License, Version 2.0!", None, None), (6, "Licensed under an Apache License, Version 2.0", None, None),
        (7, "word " * 50_000 + "All rights reserved.", None, None), (None, "Released under the MIT License.", None, None), (3, "CC-BY cc by CC  BY", None, None),
        (8, "écc by cc byé", None, None),
    ]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(_docs(spark, rows)).collect())
    assert got == sorted([
        ("1", 0, 0, None, None, "", "", 0.0), ("2", 0, 0, None, None, "", "", 0.0), ("3", 6, 3, 0, 4, "cc-by", "cc-by", 0.5), ("3", 6, 3, 0, 4, "cc-by", "cc-by", 0.5),
        ("4", 12, 1, 7, 7, "gpl", "gpl,notice:gpl", 1.0), ("5", 8, 0, None, None, "", "notice:apache-2.0", 1.0), ("6", 8, 0, None, None, "", "", 0.0),
        ("7", 50_003, 1, 50_000, 50_000, "reserved", "reserved", 0.5), ("None", 5, 0, None, None, "", "notice:mit", 1.0), ("8", 4, 0, None, None, "", "", 0.0),
    ])
    assert licenses.scan(_docs(spark, [])).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "bad.org", ""), ("allow", "net", "/"), ("allow", None, "/x"), ("block", "", "/x")]
URLS = [None, "", "no scheme.net/", "http://a.NET/", "http://a.net", "HTTPS://www.Example.net/en/x?y#z", "x://example.net/EN/", "http://xexample.net/en/",
        "http://bad.org", "http://sub.bad.org?x=://b.net/", "http://notbad.org/", "ftp://spam.com/a", "http://www.spam.com", "http:///only", "a://b.net//c://d", "http://b.net:80/x"]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), a == "block", h + p, a) for a, h, p in RULES if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, None))
    return host, path, rule, verdict or ("block" if host == "spam.com" or host.endswith(".spam.com") else "allow")


def test_filters_stay_in_proportion_to_the_listed_keys(spark):
    """A universe a thousand times the list: every level is within a stated size and membership is exact."""
    known = spark.range(60_000).selectExpr("concat('host', id, '.example/') AS key")
    listed = spark.range(0, 60_000, 1000).selectExpr("concat('host', id, '.example/') AS key")
    cascade = urls.build_cascade(listed, known)
    bits, hashes = urls.width(60, 59_940)
    assert hashes == 11 and bits == 16
    assert cascade.sizes[0] == 60 * bits and all(size <= 60 * bits for size in cascade.sizes)
    keys = [r.key for r in known.collect()]
    want = {f"host{i}.example/" for i in range(0, 60_000, 1000)}
    assert {k for k, hit in zip(keys, cascade.listed(keys), strict=True) if hit} == want


@pytest.mark.parametrize(("bits", "cascade_keys"), [(10, 100), (1, 100), (2, 1)])
def test_urls_equal_brute_force(spark, bits, cascade_keys):
    rows = [(n % 9 or None, u, "x", None) for n, u in enumerate(URLS)] + [(3, f"http://h{n}.net/p{n}", None, None) for n in range(60)] + [(3, "http://h1.net/p1", None, None)]
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    listed = spark.createDataFrame([("SPAM.com",), (None,), ("",), ("unseen.org",)], "key string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(_pages(spark, rows), rules, listed, bits, cascade_keys).collect())
    assert got == Counter((p, *brute_judge(u)) for p, u, *_ in rows)


def test_urls_of_empty_tables(spark):
    rules, listed = spark.createDataFrame([], "action string, host string, path string"), spark.createDataFrame([], "key string")
    assert urls.judge(_pages(spark, []), rules, listed).count() == 0
    assert [r.verdict for r in urls.judge(_pages(spark, [(1, "http://a.net/", None, None)]), rules, listed).collect()] == ["allow"]
