"""Registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chartweave.llm import clusters, decontaminate, exact, language, licenses, lines, minhash, packing, repair, simhash, spans, suffixes, urls
from chartweave.session import configure

LLM_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: SQL forms of the shared character classes.
SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register a function of one whole table (and of the session and folder) under ``name``."""

    def wrap(fn: Callable[[DataFrame, SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        LLM_QUERIES[name] = (run, sql)
        return fn

    return wrap


@query("op1_decontamination")
def decontamination(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, one row per pair."""
    return decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).drop("text_key")


@query("op2_simhash_near_dedup")
def simhash_near_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_groups(docs).select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op3_best_fit_packing")
def best_fit_packing(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    return packing.pack(docs, packing.tokenizer_path())


@query("op4_line_dedup", sql=f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {SQL_SPACES}), {SQL_LOWER}) AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS hit FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (hit)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '')) AS kept_sha256
FROM m GROUP BY rid
""")
def line_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Lines found in ten or more documents lose all their places."""
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_suffix_dedup")
def suffix_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one, and a digest of the rest."""
    found = suffixes.dedup_substrings(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_language_id")
def language_id(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; a fifth of them is held out from learning."""
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_substring_dedup")
def substring_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document when repeated sentence spans go."""
    found = spans.dedup_spans(docs)
    return found.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"), "text")


@query("op8_exact_dedup", sql=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), {SQL_SPACES}, '') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY length(text) DESC, doc_id)
""")
def exact_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """One verdict per document: the row that stays of its group of equal texts."""
    return exact.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Rules of the URL query, and hosts whose pages are blocked where no rule fits.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = [
    f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
]


def _url_sql() -> str:
    fits = [
        f"CASE WHEN ('.' || host) LIKE '%.{host}' AND path LIKE '{path}%' THEN '{host}{path}' END" for _, host, path in URL_RULES
    ]
    acts = " ".join(f"WHEN rule = '{host}{path}' THEN '{action}'" for action, host, path in URL_RULES)
    hosts = " OR ".join(f"('.' || host) LIKE '%.{h}'" for h in LISTED_HOSTS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {SQL_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, list_filter([{", ".join(fits)}], lambda x: x IS NOT NULL) AS fit FROM p),
b AS (SELECT page_id, host, path, list_sort(list_transform(fit, lambda x: {{'n': length(x), 'k': x}}), 'DESC')[1].k AS rule FROM r)
SELECT *, CASE {acts} WHEN {hosts} THEN 'block' ELSE 'allow' END AS verdict FROM b
"""


@query("op9_url_filters", "pages", sql=_url_sql())
def url_filters(pages: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict."""
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(pages, rules, spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string"))


def _license_sql() -> str:
    places = [
        "list_filter(generate_series(0, len(w) - 1), lambda i: {})".format(" AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(phrase.split(), 1)))
        for phrase in licenses.PHRASES
    ]
    base = [f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(licenses.PHRASES.values())]
    # The templates' markup as patterns over words that each have a space on both sides.
    patterns = {
        "notice:apache-2.0": "(  this (  [^ ]+ ){1,3}  is )?  licensed   under   the   apache   license (  version )?  2   0 ",
        "notice:cc-by": "(  this   work   is )?  (licensed|released|available)   under (  a )?(  the )?  cc   by (  [0-9]+ ){1,2}",
        "notice:cc-by-nc": "(  this   work   is )?  (licensed|released|available)   under (  a )?(  the )?  cc   by   nc (  [0-9]+ ){1,2}",
        "notice:gpl": "(  [^ ]+ ){0,2}  is (  free   software   and   is )?  licensed   under   the   gnu (  lesser )?  general   public   license   version   [23] ",
        "notice:mit": "  (released|licensed|distributed)   under   the   mit   license ",
    }
    # Longer wordings: words stand for themselves, #n for a number, @ for any word.
    gnu = "you can redistribute it and or modify it under the terms of (version ([0-9]+){1,2} of )?the gnu KIND general public license as published by the free software foundation"
    bsd = (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [0-9]? "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [0-9]? redistributions in binary form must "
        "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    )
    number = "(  [0-9]+ )"
    wordings = {
        "header:agpl": gnu.replace("KIND", "affero"), "header:gpl": gnu.replace("KIND ", ""), "header:lgpl": gnu.replace("KIND", "(lesser|library)"),
        "header:apache-2.0": "licensed under the apache license version #2 #0 the license you may not use (this|these) (file|files) except in compliance with the license",
        "header:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v #2 #0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "notice:cc0": "to the extent possible under law @{1,12} has waived all copyright and related or (neighboring|neighbouring) rights",
        "notice:creative-commons-by": "creative commons attribution [0-9]+{1,2} (international)? license",
        "notice:creative-commons-by-sa": "creative commons attribution (share|sharealike) (alike)? [0-9]+{1,2} (international)? license",
        "text:bsd-2": bsd,
        "text:bsd-3": bsd + " [0-9]? neither the name of @{1,12} nor the names of (its|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "text:isc": "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "text:mit": "permission is hereby granted (free of charge)? to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice (including the next paragraph)? shall be included in all copies or substantial portions of the software",
    }
    for label, wording in wordings.items():
        tight = wording.replace("([0-9]+)", "N").replace("[0-9]+", "N").replace("[0-9]?", "N?").replace(" ", "~")
        spaced = re.sub(r"#([0-9])|([a-z]+)", lambda m: f"  {m[1] or m[2]} ", tight)
        patterns[label] = spaced.replace("~", "").replace("@", "(  [^ ]+ )").replace("N", number)
    notices = [f"CASE WHEN regexp_matches(j, '{p}') THEN '{label}' END" for label, p in patterns.items()]
    names = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {SQL_LOWER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
q AS (SELECT *, array_to_string(list_transform(w, lambda x: '  ' || x || ' '), '') AS j, {", ".join(f"{p} AS p{n}" for n, p in enumerate(places))} FROM t),
l AS (SELECT *, list_concat({", ".join(f"p{n}" for n in range(1, len(places)))}, p0) AS places, [{", ".join(base)}] AS bl, [{", ".join(notices)}] AS nl FROM q)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  {names.format("bl")} AS base_labels, {names.format("list_concat(bl, nl)")} AS labels,
  CASE WHEN len(list_filter(nl, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS score FROM l
"""


@query("op10_license_scan", sql=_license_sql())
def license_scan(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan(docs)


@query("op11_minhash_near_dedup")
def minhash_near_dedup(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document."""
    found = minhash.near_groups(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _cluster_sql() -> str:
    """Unrolled rounds; whole numbers throughout, the floor of a mean by its remainder."""
    far = "list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {clusters.WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id), x) - 1 AS k, x AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id), x) <= {clusters.CENTROIDS})"""]
    for r in range(clusters.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': {far}, 'k': k}}) AS m FROM v CROSS JOIN c{r} c GROUP BY rid)")
        if r < clusters.ROUNDS:
            steps.append(f"""s{r} AS (SELECT m.k AS k, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, generate_series(1, {clusters.WIDTH}) g(i) GROUP BY ALL),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN n{r} n ON c.k = n.k)""")
    last = clusters.ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c.k::INTEGER AS cluster, m.d::BIGINT AS distance, sum(m.d) OVER (PARTITION BY c.k)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.k = a.m.k"""


@query("op12_centroid_clusters", "embeddings", sql=_cluster_sql())
def centroid_clusters(vectors: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after five rounds."""
    return clusters.cluster(vectors)


#: The trial's damage, then a Viterbi table per row with the least (cost, letters) of each state, then the letters played back.
REPAIR_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
g AS MATERIALIZED (SELECT row_number() OVER () AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
  lambda s, b: xor(s >> 8, t.t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS code FROM conversations c JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id, t),
d AS (SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, generate_series(1, CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE code <> 0),
r AS (SELECT g, turn, role, text, left(role, 1) AS ini, row_number() OVER w AS i,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, lag(left(role, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text)),
h AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS again FROM r),
f AS MATERIALIZED (SELECT *, cut = '' AS blank, cut <> '' AND again > 1 AS dup, cut <> '' AND again = 1 AND right(cut, 1) NOT IN ('.', '!', '?') AS trunc FROM h),
ins(q, p, c, a) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
ops(q, ini, p, c, a) AS (VALUES (0, '', 0, 2, 'D'), (1, '', 1, 2, 'D'), (2, '', 2, 2, 'D'), (3, '', 3, 2, 'D'), (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'),
  (3, 'u', 2, 0, 'K'), (0, '', 2, 1, 'R'), (1, '', 2, 1, 'R'), (2, '', 3, 1, 'R'), (3, '', 2, 1, 'R')),
moves AS MATERIALIZED (SELECT ins.q, o.p, o.ini, ins.c + o.c AS c, ins.a || o.a AS a, o.a AS op FROM ins JOIN ops o ON o.q = ins.p),
vit AS (SELECT g, 0::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': ''} AS s FROM g UNION ALL
  SELECT v.g, f.i, m.p, min({'c': v.s.c + m.c + CASE WHEN f.trunc AND m.op <> 'D' THEN 5 ELSE 0 END, 'a': v.s.a || m.a})
  FROM vit v JOIN f ON f.g = v.g AND f.i = v.i + 1 JOIN moves m ON m.q = v.q AND (m.ini = '' OR m.ini = f.ini) AND (m.op = 'D' OR NOT (f.blank OR f.dup)) GROUP BY v.g, f.i, m.p),
e AS (SELECT v.g, min({'c': v.s.c + ins.c, 'a': v.s.a || ins.a}) AS s FROM vit v JOIN ins ON ins.q = v.q AND ins.p IN (0, 3)
  WHERE v.i = (SELECT count(*) FROM f WHERE f.g = v.g) GROUP BY v.g),
x AS (SELECT g, unnest(string_split(s.a, '')) AS x, generate_subscripts(string_split(s.a, ''), 1) AS n FROM e WHERE s.a <> ''),
y AS (SELECT *, sum((x <> 'I')::INT) OVER w AS i, sum((x <> 'D')::INT) OVER w AS o, sum((x <> 'D')::INT) OVER (PARTITION BY g) AS l FROM x WINDOW w AS (PARTITION BY g ORDER BY n)),
z AS (SELECT y.g, sha256(string_agg(CASE WHEN x = 'K' THEN f.role WHEN (o + l) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY n)) AS h
  FROM y LEFT JOIN f ON f.g = y.g AND f.i = y.i WHERE x <> 'D' GROUP BY y.g),
b AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (trunc) AS trunc,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(trunc, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.s.c::BIGINT AS cost, e.s.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM g JOIN e ON e.g = g.g LEFT JOIN z ON z.g = g.g LEFT JOIN b ON b.g = g.g
"""


@query("op13_conversation_repair", "conversations", sql=REPAIR_SQL)
def conversation_repair(conversations: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair.repair(conversations, damaged=True).verdicts()


LLM_QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
