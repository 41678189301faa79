"""Queries over texts: language, personal data, segments, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave import fixed_values as V
from chartweave.functions.text import PIECES, pieces
from chartweave.operators import entities as E
from chartweave.operators import language, merging, negation, phi, scanner, segments, tagger
from chartweave.plans.registry import Tables, query
from chartweave.scale import literal_table, lookup_join

FRENCH = ["le", "la", "les", "des", "du", "une", "dans", "pour", "que ", "eau"]
ENGLISH = ["the", "and", "of", "with", "was", "that ", "this", "er"]
RULES = [
    ("EMAIL", r"([\p{L}\p{N}._]+@[a-z0-9.]+[a-z])"),
    ("PHONE", r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})"),
    ("CARD", r"([0-9]{16})"),
    ("IP", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"),
]
SQL_PIECES = PIECES
SQL_SENTENCE = r"(?:[^.!?\n]+|[.!?]+[^.!?\s])+[.!?]*\s*|[.!?\n]+\s*"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def notes(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("note_id"), "text", "lang")


_LANG_SQL = f"""
WITH p AS (SELECT doc_id, text, lang, lower(text) AS low,
                  regexp_extract_all(lower(text), '{SQL_PIECES}') AS ps FROM documents),
s AS (SELECT doc_id, text, lang,
  len(list_filter({sql_list(FRENCH)}, lambda m: contains(low, m)))
  + CASE WHEN len(regexp_extract_all(low, '{V.FRENCH_ACCENTS}')) > 5 THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(range(1, len(ps) - 1), lambda i:
        ps[i] IN ('le','la','les','un','une','des','du','au','aux') AND ps[i + 1] = ' ')) > 5 THEN 2 ELSE 0 END AS fr,
  len(list_filter({sql_list(ENGLISH)}, lambda m: contains(low, m))) AS en FROM p)
"""


@query(
    "lang_score",
    _LANG_SQL + "SELECT doc_id, fr AS fr_score, en AS en_score, CASE WHEN fr >= en THEN 'fr' ELSE 'en' END AS heuristic_lang FROM s",
)
def lang_score(t: Tables) -> DataFrame:
    """P1."""
    scored = language.language_scores(t.documents.select("doc_id", "text"), "text", FRENCH, ENGLISH)
    return scored.select("doc_id", "fr_score", "en_score", "heuristic_lang")


@query(
    "lang_route",
    f"""
WITH p AS (SELECT doc_id, text, lang, source, lower(text) AS low,
                  regexp_extract_all(lower(text), '{SQL_PIECES}') AS ps FROM documents),
s AS (SELECT doc_id, text, lang, source,
  len(list_filter({sql_list(V.FRENCH_MARKERS)}, lambda m: contains(low, m)))
  + CASE WHEN len(regexp_extract_all(low, '{V.FRENCH_ACCENTS}')) > 5 THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(range(1, len(ps) - 1), lambda i:
        ps[i] IN ('le','la','les','un','une','des','du','au','aux') AND ps[i + 1] = ' ')) > 5 THEN 2 ELSE 0 END AS fr,
  len(list_filter({sql_list(V.ENGLISH_MARKERS)}, lambda m: contains(low, m))) AS en FROM p)
SELECT doc_id, CASE WHEN source = 'src0' THEN 'en'
  WHEN length(text) > 50 AND lang <> 'de' THEN CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END
  WHEN fr >= en THEN 'fr' ELSE 'en' END AS language FROM s""",
)
def lang_route(t: Tables) -> DataFrame:
    """The model column is silent for German, one source is forced to English."""
    docs = t.documents.select(
        "doc_id", "text", F.when(F.col("lang") != "de", F.col("lang")).alias("model"),
        F.when(F.col("source") == "src0", "en").alias("forced"),
    )
    return language.route_language(docs, "text", "model", "forced").select("doc_id", "language")


def _phi_sql(rules, table="documents", key="doc_id") -> str:
    parts = []
    for i, (c, p) in enumerate(rules):
        x = f"regexp_extract_all(text, '{p}', 1)"
        parts.append(
            f"SELECT {key}, '{c}' AS category, {i} AS r, unnest({x}) AS value, generate_subscripts({x}, 1) AS i FROM {table}"
        )
    return (
        "m AS (" + " UNION ALL ".join(parts) + f"), d AS (SELECT {key}, category, value, min(r * 1000000 + i) AS o "
        f"FROM m WHERE length(value) >= 2 GROUP BY ALL)"
    )


@query(
    "phi_extract",
    "WITH " + _phi_sql(RULES)
    + " SELECT doc_id, category, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS seq FROM d",
)
def phi_extract(t: Tables) -> DataFrame:
    """P3."""
    return phi.extract_phi(t.documents, "text", RULES, "doc_id", "")


def _address_scorer(texts: list[str]) -> list[list[dict]]:
    """Stands in for a model: scores addresses, and noise below the threshold."""
    import re

    found = []
    for text in texts:
        spans = [
            {"text": m[0], "label": label, "score": score, "start": m.start()}
            for label, score, pattern in (
                ("adresse ip", 0.9, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("courriel", 0.8, r"(?:[^\W_]|[._])+@[a-z0-9.]+[a-z]"),
            )
            for m in re.finditer(pattern, text)
        ]
        found.append([*spans, {"text": "weak", "label": "courriel", "score": 0.2}])
    return found


@query(
    "phi_merge",
    "WITH " + _phi_sql(RULES[:2])
    + """, w AS (SELECT doc_id, 'IP' AS category, unnest(regexp_extract_all(text, '([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})', 1)) AS value FROM documents
  UNION ALL SELECT doc_id, 'EMAIL', unnest(regexp_extract_all(text, '([\\p{L}\\p{N}._]+@[a-z0-9.]+[a-z])', 1)) FROM documents),
  u AS (SELECT doc_id, category, value FROM d UNION SELECT doc_id, category, value FROM w WHERE length(value) >= 2)
  SELECT doc_id, category, count(*) AS n, count(DISTINCT value) AS n_values FROM u GROUP BY ALL""",
)
def phi_merge(t: Tables) -> DataFrame:
    """Spans of a batch scorer over the whole texts join the pattern spans."""

    own = phi.extract_phi(notes(t), "text", RULES[:2], flags="")
    scored = phi.score_phi(notes(t), _address_scorer, labels={"adresse ip": "IP", "courriel": "EMAIL"})
    merged = phi.merge_phi(own.withColumn("note_id", F.col("note_id").cast("string")), scored)
    return merged.groupBy(F.col("note_id").cast("long").alias("doc_id"), "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values")
    )


@query(
    "phi_scored_redact",
    """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\p{L}\\p{N}._]+@[a-z0-9.]+[a-z]', '[EMAIL]', 'g'),
    '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[ID]', 'g') AS x FROM documents),
  b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '\\[EMAIL\\]\\s*(?:\\[EMAIL\\]\\s*)*', '[EMAIL] ', 'g'), '\\[ID\\]\\s*(?:\\[ID\\]\\s*)*', '[ID] ', 'g'), E' \\t\\n\\r\\f\\x0B') AS clean FROM a)
  SELECT doc_id, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM b""",
)
def phi_scored_redact(t: Tables) -> DataFrame:
    """A scorer's spans over whole texts are cut out by offset."""
    docs = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("note_id"), "text", F.lit("en").alias("language"))
    spans = phi.score_phi(docs, _address_scorer, labels={"adresse ip": "ID", "courriel": "EMAIL"})
    clean = phi.redact(docs, "text", {}, spans=spans)
    return clean.select("doc_id", F.length("clean_text").alias("clean_chars"), F.md5("clean_text").alias("clean_md5"))


@query(
    "phi_redact",
    "WITH " + _phi_sql(RULES)
    + """, v AS (SELECT doc_id, list(value || chr(1) || category ORDER BY length(value) DESC, o) AS vs FROM d GROUP BY doc_id),
  c AS (SELECT doc_id, len(vs) AS n_values, trim(CASE WHEN vs IS NULL THEN text ELSE list_reduce(list_prepend(text, vs),
      lambda acc, x: replace(acc, split_part(x, chr(1), 1), '[' || split_part(x, chr(1), 2) || ']')) END, E' \\t\\n\\r\\f\\x0B') AS clean
    FROM documents LEFT JOIN v USING (doc_id))
  SELECT doc_id, coalesce(n_values, 0) AS n_values, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM c""",
)
def phi_redact(t: Tables) -> DataFrame:
    """P5."""
    docs = t.documents.select("doc_id", "text", F.lit("x").alias("language"))
    clean = phi.redact(docs, "text", {"x": RULES}, flags="")
    return clean.select(
        "doc_id", F.size("phi").alias("n_values"), F.length("clean_text").alias("clean_chars"),
        F.md5("clean_text").alias("clean_md5"),
    )


@query(
    "span_redact",
    f"""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '{SQL_PIECES}') AS ps FROM conversations),
c AS (SELECT conv_id, turn, array_to_string(list_transform(ps, lambda w:
    CASE WHEN lower(w) IN ('the', 'of', 'and', 'de', 'la') THEN '[NAME]' ELSE w END), '') AS raw FROM p),
r AS (SELECT conv_id, turn, trim(regexp_replace(raw, '(\\[NAME\\]\\s*)+', '[NAME] ', 'g'), E' \\t\\n\\r\\f\\x0B') AS clean FROM c)
SELECT conv_id, turn, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM r""",
)
def span_redact(t: Tables) -> DataFrame:
    """Spans by offset, runs of a tag collapsed."""
    low = t.conversations.withColumn("ps", pieces(F.col("text")))
    from chartweave.functions.text import running_starts

    spans = F.filter(
        F.zip_with(
            "ps", running_starts(F.transform("ps", F.length)),
            lambda p, s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), F.lit("NAME").alias("category"), F.lower(p).alias("w")),
        ),
        lambda s: s["w"].isin("the", "of", "and", "de", "la"),
    )
    clean = phi.redact_spans(F.col("text"), F.col("spans"))
    return low.withColumn("spans", spans).select(
        "conv_id", "turn", clean.alias("clean")
    ).select("conv_id", "turn", F.length("clean").alias("clean_chars"), F.md5("clean").alias("clean_md5"))


@query(
    "span_fusion",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s FROM events),
g AS (SELECT *, CASE WHEN s - lag(s) OVER w > 1800000000 THEN 1 ELSE 0 END AS j FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
i AS (SELECT *, sum(j) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event,
  max(s) - min(s) AS span_us FROM i GROUP BY user_id, island""",
)
def span_fusion(t: Tables) -> DataFrame:
    """P7 over a user's events: two-level islands, safe for a user with any share of rows."""
    e = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start")).withColumn(
        "end", F.col("start")
    )
    islands = phi.span_islands(e, ["user_id"], 1_800_000_000, tie="event_id", block=21_600_000_000)
    return islands.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"),
        (F.max("end") - F.min("start")).alias("span_us"),
    )


@query(
    "phi_compare",
    "WITH " + _phi_sql(RULES)
    + """, a AS (SELECT doc_id, category, value FROM d WHERE category IN ('EMAIL', 'PHONE')),
  b AS (SELECT DISTINCT doc_id, 'CARD' AS category, unnest(regexp_extract_all(text, '(4[0-9]{15})', 1)) AS value FROM documents
        UNION SELECT DISTINCT doc_id, 'IP', unnest(regexp_extract_all(text, '([0-9]{2,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})', 1)) FROM documents),
  j AS (SELECT coalesce(d.category, b.category) AS category, d.value IS NOT NULL AS gold, a.value IS NOT NULL AS ha, b.value IS NOT NULL AS hb
        FROM d FULL JOIN b ON d.doc_id = b.doc_id AND d.category = b.category AND d.value = b.value
        LEFT JOIN a ON a.doc_id = d.doc_id AND a.category = d.category AND a.value = d.value)
  SELECT category, count(*) FILTER (gold) AS expected,
    count(*) FILTER (ha AND gold) AS words_hits, count(*) FILTER (NOT ha AND gold) AS words_misses, count(*) FILTER (ha AND NOT gold) AS words_extras,
    count(*) FILTER (hb AND gold) AS digits_hits, count(*) FILTER (NOT hb AND gold) AS digits_misses, count(*) FILTER (hb AND NOT gold) AS digits_extras
  FROM j GROUP BY category""",
)
def phi_compare(t: Tables) -> DataFrame:
    """P11."""
    expected = phi.extract_phi(t.documents, "text", RULES, "doc_id", "")
    words = phi.extract_phi(t.documents, "text", RULES[:2], "doc_id", "")
    digits = phi.extract_phi(
        t.documents, "text",
        [("CARD", r"(4[0-9]{15})"), ("IP", r"([0-9]{2,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})")], "doc_id", "",
    )
    return phi.compare_detectors(expected, {"words": words, "digits": digits}, "doc_id")


# ---------------------------------------------------------------- segments
@query(
    "sentences",
    f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '{SQL_SENTENCE}') AS ss FROM documents)
SELECT doc_id, len(ss) AS n_sentences, CAST(list_sum(list_transform(ss, lambda x: length(x))) AS BIGINT) AS total_chars,
  list_max(list_transform(ss, lambda x: length(x))) AS longest,
  CAST(list_sum(list_transform(range(1, len(ss) + 1), lambda i: length(array_to_string(ss[1:i - 1], '')))) AS BIGINT) AS sum_starts
FROM s WHERE len(ss) > 0""",
)
def sentences(t: Tables) -> DataFrame:
    """E1."""
    rows = segments.sentences(t.documents, "text", ("doc_id",))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("total_chars"),
        F.max(F.length("sentence")).alias("longest"), F.sum("start").alias("sum_starts"),
    )


_ABBREVIATIONS_SQL = r"""
tk AS (SELECT regexp_replace(regexp_replace(unnest(string_split_regex(lower(text), '\s+')), '^[^\p{L}0-9]+', ''), '[^\p{L}0-9.]+$', '') AS t FROM documents),
ty AS (SELECT CASE WHEN regexp_matches(t, '[^.]\.$') THEN left(t, length(t) - 1) ELSE t END AS type, regexp_matches(t, '[^.]\.$')::INT AS e FROM tk),
ct AS (SELECT type, sum(e)::BIGINT AS k, sum(1 - e)::BIGINT AS n FROM ty WHERE regexp_matches(type, '\p{L}') GROUP BY type),
pt AS (SELECT sum(k)::DOUBLE / sum(k + n) AS p FROM ct),
ab AS (SELECT type, k, n, 2 * (k * ln(0.99::DOUBLE) + n * ln(1 - 0.99::DOUBLE) - k * ln(p) - n * ln(1 - p)) * exp(-length(replace(type, '.', '')))
  * (length(type) - length(replace(type, '.', '')) + 1) * pow(length(replace(type, '.', '')), -n::DOUBLE) AS score FROM ct, pt WHERE k > 0),
abb AS MATERIALIZED (SELECT * FROM ab WHERE score >= 0.3)"""


@query("abbreviations", f"WITH {_ABBREVIATIONS_SQL} SELECT type, k AS with_period, n AS without, round(score, 4) AS score FROM abb")
def abbreviations(t: Tables) -> DataFrame:
    """Abbreviations learnt from all documents."""
    found = segments.abbreviations(t.documents)
    return found.withColumn("score", F.round("score", 4))


@query(
    "learned_sentences",
    rf"""WITH {_ABBREVIATIONS_SQL},
s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_SENTENCE}')) AS x, generate_subscripts(regexp_extract_all(text, '{SQL_SENTENCE}'), 1) AS i FROM documents),
l AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(lower(regexp_extract(x, '(\S+)\s*$', 1)), '^[^\p{{L}}0-9]+', ''), '[^\p{{L}}0-9.]+$', ''), '^(.*[^.])\.$', 1) AS type FROM s),
b AS (SELECT l.*, abb.type IS NOT NULL AS goes_on FROM l LEFT JOIN abb ON abb.type = l.type AND l.type <> ''),
g AS (SELECT *, sum(1 - coalesce(before, false)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(goes_on) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b)),
m AS (SELECT doc_id, g, sum(length(x)) AS n, string_agg(x, '' ORDER BY i) AS x FROM g GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_sentences, max(n)::BIGINT AS longest, md5(string_agg(x, '|' ORDER BY g)) AS digest FROM m GROUP BY doc_id""",
)
def learned_sentences(t: Tables) -> DataFrame:
    """E1 with abbreviations learnt from the documents."""
    known = segments.abbreviations(t.documents)
    rows = segments.learned_sentences(t.documents, known, "text", ("doc_id",))
    ordered = F.array_sort(F.collect_list(F.struct("sentence_id", "sentence")))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).cast("long").alias("longest"), ordered.alias("o")
    ).select("doc_id", "n_sentences", "longest", F.md5(F.array_join("o.sentence", "|").cast("binary")).alias("digest"))


@query(
    "chunk_pack",
    f"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '{SQL_SENTENCE}'),
    lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))) AS ws FROM documents),
r(doc_id, ws, i, chunk, cur) AS (
  SELECT doc_id, ws, 1, 0, ws[1] FROM s WHERE len(ws) > 0
  UNION ALL
  SELECT doc_id, ws, i + 1, CASE WHEN cur + ws[i + 1] > 60 THEN chunk + 1 ELSE chunk END,
    CASE WHEN cur + ws[i + 1] > 60 THEN ws[i + 1] ELSE cur + ws[i + 1] END
  FROM r WHERE i < len(ws))
SELECT doc_id, chunk AS chunk_id, max(cur) AS words FROM r GROUP BY doc_id, chunk""",
)
def chunk_pack(t: Tables) -> DataFrame:
    """E2."""
    from chartweave.functions.text import count_tokens

    rows = segments.chunks(t.documents, "text", 60, ("doc_id",))
    return rows.select("doc_id", "chunk_id", count_tokens(F.col("chunk")).alias("words"))


# ---------------------------------------------------------------- entities
LABELS = [("a", "click", "problem"), ("a", "view", "test"), ("b", "click", "treatment"), ("b", "error", "problem")]
_LABEL_SQL = "l(source, label, category) AS (VALUES ('a','click','problem'),('a','view','test'),('b','click','treatment'),('b','error','problem'))"


@query(
    "label_map",
    f"""
WITH {_LABEL_SQL}, e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, event_type AS label FROM events),
j AS (SELECT e.*, coalesce(l.category, CASE WHEN e.source = 'b' THEN 'problem' END) AS category FROM e LEFT JOIN l ON e.source = l.source AND e.label = l.label)
SELECT source, label, category, count(*) AS n FROM j WHERE category IS NOT NULL GROUP BY ALL""",
)
def label_map(t: Tables) -> DataFrame:
    """Unmapped labels are dropped for one source and fall back for the other."""
    e = t.events.select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("event_type").alias("label")
    )
    table = literal_table(t.spark, LABELS, "source string, label string, category string")
    return E.map_labels(e, table, {"b": "problem"}).groupBy("source", "label", "category").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "scored_spans",
    f"""
WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{SQL_PIECES}')) AS w FROM conversations)
SELECT source, label, count(*) AS n FROM (
  SELECT 'upper' AS source, 'capital' AS label FROM s WHERE regexp_matches(w, '^\\p{{Lu}}')
  UNION ALL SELECT 'long', 'length' FROM s WHERE regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]') AND length(w) >= 12) GROUP BY ALL""",
)
def scored_spans(t: Tables) -> DataFrame:
    """Two batch scorers over packed chunks of the conversations."""

    def upper(texts):
        import regex

        return [
            [{"text": m, "label": "capital", "score": 0.9} for m in regex.findall(r"[\p{L}\p{N}_]+", x) if regex.match(r"\p{Lu}", m)]
            for x in texts
        ]

    def long(texts):
        import regex

        return [
            [{"text": m, "label": "length", "score": 0.7} for m in regex.findall(r"[\p{L}\p{N}_]+", x) if len(m) >= 12]
            for x in texts
        ]

    base = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), "text")
    spans = E.score_chunks(segments.chunks(base, "text", 50), {"upper": upper, "long": long})
    return spans.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fragment_filter",
    f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
f AS (SELECT doc_id, lower(w) AS w FROM w)
SELECT doc_id, count(*) AS words, count(*) FILTER (length(w) <= 3 OR (w NOT IN ({sql_list(V.SHORT_TERMS)[1:-1]}) AND length(w) <= 5
  AND regexp_matches(w, '^\\p{{Ll}}') AND length(w) - length(translate(w, 'aeiou', '')) <= 1)) AS fragments FROM f GROUP BY doc_id""",
)
def fragment_filter(t: Tables) -> DataFrame:
    """E5."""
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.count_if(E.is_fragment(F.col("w"))).alias("fragments")
    )


@query(
    "subword_repair",
    """
WITH r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(text, E' \\t\\n\\r\\f\\x0B'), '\\s*##', '', 'g'), '\\s+', ' ', 'g'), E' \\t\\n\\r\\f\\x0B') AS f FROM documents)
SELECT doc_id, length(f) AS chars, md5(f) AS fixed_md5 FROM r WHERE length(f) > 1""",
)
def subword_repair(t: Tables) -> DataFrame:
    """E6."""
    fixed = t.documents.select("doc_id", E.repair_subwords(F.col("text")).alias("f")).where("f is not null")
    return fixed.select("doc_id", F.length("f").alias("chars"), F.md5("f").alias("fixed_md5"))


@query(
    "mention_offsets",
    f"""
WITH p AS (SELECT conv_id, turn, text, lower(text) AS low, regexp_extract_all(lower(text), '{SQL_PIECES}') AS ps FROM conversations),
k AS (SELECT conv_id, turn, low, w, len(list_filter(ps, lambda x: x = w)) AS n FROM p, (VALUES ('the'), ('de'), ('la')) v(w)),
m AS (SELECT conv_id, turn, low, w, unnest(range(1, n + 1)) AS i FROM k WHERE n > 0)
SELECT conv_id, turn, w AS mention, i AS k,
  CAST(list_sum(list_transform(string_split(low, w)[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(w) AS start FROM m""",
)
def mention_offsets(t: Tables) -> DataFrame:
    """The k-th mention of a word takes its k-th occurrence."""
    src = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), "conv_id", "turn", "text")
    words = src.select(
        "note_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("seq", "text")
    ).where(F.col("text").isin("the", "de", "la")).select(
        "note_id", F.lit(0).alias("chunk_id"), "seq", "text", F.lit("w").alias("source")
    )
    placed = E.assign_offsets(words, src)
    from pyspark.sql import Window

    w = Window.partitionBy("note_id", "text").orderBy("seq")
    key = F.split("note_id", "-")
    return placed.select(
        F.get(key, F.lit(0)).cast("long").alias("conv_id"), F.get(key, F.lit(1)).cast("long").alias("turn"),
        F.col("text").alias("mention"), F.row_number().over(w).cast("long").alias("k"), F.col("start").cast("long").alias("start"),
    )


def bigrams(t: Tables) -> DataFrame:
    """Lexicon: two-word phrases of the benchmark items."""
    ps = pieces(F.lower("text"))
    b = t.benchmark.select(ps.alias("ps"))
    grams = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("ps") - 3), lambda i: (F.get("ps", i + 1) == " ")),
        lambda i: F.concat(F.get("ps", i), F.get("ps", i + 1), F.get("ps", i + 2)),
    )
    return b.where(F.size("ps") >= 3).select(F.explode(grams).alias("term")).where(F.length("term") >= 6).distinct()


BIGRAM_SQL = f"""
bp AS (SELECT regexp_extract_all(lower(text), '{SQL_PIECES}') AS ps FROM benchmark),
lex AS (SELECT DISTINCT term FROM (SELECT unnest(list_transform(list_filter(range(1, len(ps) - 1), lambda i: ps[i + 1] = ' '),
   lambda i: ps[i] || ps[i + 1] || ps[i + 2])) AS term FROM bp) WHERE length(term) >= 6),
dp AS (SELECT doc_id, regexp_extract_all(lower(text), '{SQL_PIECES}') AS ps FROM documents),
dg AS (SELECT doc_id, unnest(range(1, len(ps) - 1)) AS i, ps FROM dp),
hits AS (SELECT doc_id, i, ps[i] || ps[i + 1] || ps[i + 2] AS term FROM dg WHERE ps[i] || ps[i + 1] || ps[i + 2] IN (SELECT term FROM lex))
"""


@query(
    "dictionary_tags",
    f"WITH {BIGRAM_SQL} SELECT doc_id, count(*) AS n_hits, count(DISTINCT term) AS n_terms, min(term) AS first_term FROM hits GROUP BY doc_id",
)
def dictionary_tags(t: Tables) -> DataFrame:
    """E8."""
    hits = tagger.tag_terms(t.documents, bigrams(t), "text", "term", ("doc_id",))
    return hits.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("term").alias("n_terms"), F.min("term").alias("first_term")
    )


@query("trained_tags")
def trained_tags(t: Tables) -> DataFrame:
    """E3 + E7 by a trained tagger: learnt from dictionary hits of a bounded sample outside every
    fifth document, applied to all; per document the dictionary's spans, the model's, and those in both."""
    from chartweave.operators import perceptron

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lexicon = bigrams(t)
    sample = perceptron.dictionary_sample(t.documents.where(~held_out), lexicon, "term", "doc_id")
    found = perceptron.tag_texts(t.documents, perceptron.fit(sample, ["term"]), "doc_id", scored=False).select("doc_id", "start", "end", F.lit(1).alias("model"))
    hits = tagger.tag_terms(t.documents, lexicon, "text", "term", ("doc_id",)).select("doc_id", "start", "end")
    # Overlapping hits are one span: a hit opens one where it starts behind all earlier ends.
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("_run", F.when(reach.isNull() | (F.col("start") >= reach), F.col("start")))
    runs = opened.withColumn("_run", F.last("_run", ignorenulls=True).over(w)).groupBy("doc_id", F.col("_run").alias("start")).agg(F.max("end").alias("end"))
    both = runs.withColumn("gold", F.lit(1)).join(found, ["doc_id", "start", "end"], "full")
    counts = both.groupBy("doc_id").agg(F.count("gold").alias("n_dictionary"), F.count("model").alias("n_model"), F.count_if(F.col("gold").isNotNull() & F.col("model").isNotNull()).alias("n_both"))
    ids = t.documents.select("doc_id", held_out.alias("held_out"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dictionary", "n_model", "n_both")]
    return ids.join(counts, "doc_id", "left").select("doc_id", "held_out", *zero)


#: Dictionary hits with offsets, and the greedy folds over one document's hits.
PLACED_SQL = BIGRAM_SQL + """, placed AS (SELECT doc_id, ps[i] || ps[i + 1] || ps[i + 2] AS t, length(array_to_string(ps[1:i - 1], '')) AS s FROM dg
   WHERE ps[i] || ps[i + 1] || ps[i + 2] IN (SELECT term FROM lex))
"""


@query(
    "text_scan",
    f"""WITH {PLACED_SQL}, o AS (SELECT doc_id, list({{'t': t, 's': s, 'e': s + length(t), 'c': 'C:' || t[1:4]}} ORDER BY length(t) DESC, t, s) AS hs FROM placed GROUP BY doc_id),
  k AS (SELECT doc_id, unnest(list_reduce(hs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.c = x.c OR (x.s < a.e AND x.e > a.s))) > 0 THEN acc ELSE list_append(acc, x) END, hs[1:0])) AS h FROM o)
  SELECT doc_id, CAST(h.s AS INTEGER) AS start, CAST(h.e AS INTEGER) AS "end", h.t AS term, h.c AS concept_id FROM k""",
)
def text_scan(t: Tables) -> DataFrame:
    """Greedy choice among dictionary hits."""
    lookup = bigrams(t).select(
        "term", F.concat(F.lit("C:"), F.substring("term", 1, 4)).alias("concept_id"), F.col("term").alias("name"),
        F.lit("exact_label").alias("match_type"),
    )
    return scanner.scan(t.documents, lookup, None, "text", "doc_id").select("doc_id", "start", "end", "term", "concept_id")


@query(
    "mention_dedup",
    """
WITH w AS (SELECT conv_id, turn, unnest(ws) AS text, generate_subscripts(ws, 1) AS i FROM
  (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM conversations)),
r AS (SELECT conv_id, text, turn * 100000 + i AS seq, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn, i) AS rn FROM w)
SELECT conv_id, text, seq FROM r WHERE rn = 1""",
)
def mention_dedup(t: Tables) -> DataFrame:
    """First mention of every word per conversation; safe for a huge conversation."""
    words = t.conversations.select(
        "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("i", "text")
    ).select("conv_id", "text", (F.col("turn") * 100000 + F.col("i") + 1).alias("seq"))
    return E.dedup_mentions(words, ("conv_id",), hot_keys=True).select("conv_id", "text", "seq")


@query("fragment_merge")
def fragment_merge(t: Tables) -> DataFrame:
    """Words of the conversations merged into benchmark phrases."""
    src = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), F.col("text").alias("clean_text"))
    from chartweave.functions.text import running_starts

    ps = pieces(F.col("clean_text"))
    spans = src.withColumn("ps", ps).select(
        "note_id", F.posexplode(F.zip_with("ps", running_starts(F.transform("ps", F.length)), lambda p, s: F.struct(p.alias("text"), s.alias("start")))).alias("seq", "e")
    ).where(F.col("e.text").rlike(r"^[\p{L}\p{N}_]")).select(
        "note_id", F.lit("problem").alias("category"), "seq", "e.text", F.lit(0.8).alias("score"), "e.start",
        (F.col("e.start") + F.length("e.text")).alias("end"), F.lit("word").alias("source"),
    )
    lex = bigrams(t)

    def resolve(texts: DataFrame) -> DataFrame:
        return texts.join(lex.select(F.col("term").alias("_t")), F.lower("text") == F.col("_t"), "left_semi").select(
            "text", F.lit(True).alias("exact"), F.lit(1.0).alias("score")
        )

    merged = merging.merge_fragments(spans, src, resolve=resolve)
    return merged.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "merged").alias("n_merged")
    )


@query(
    "overlap_fusion",
    f"""WITH {PLACED_SQL}, o AS (SELECT doc_id, list({{'s': s, 'e': s + length(t)}} ORDER BY length(t) DESC, s, s + length(t)) AS hs FROM placed GROUP BY doc_id),
  k AS (SELECT doc_id, unnest(list_reduce(hs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a:
     greatest(least(a.e, x.e) - greatest(a.s, x.s), 0) / CAST(a.e - a.s + x.e - x.s - greatest(least(a.e, x.e) - greatest(a.s, x.s), 0) AS DOUBLE) >= 0.2)) > 0 THEN acc ELSE list_append(acc, x) END, hs[1:0])) AS h FROM o)
  SELECT doc_id, count(*) AS n, CAST(sum(h.s) AS BIGINT) AS sum_start FROM k GROUP BY doc_id""",
)
def overlap_fusion(t: Tables) -> DataFrame:
    """Overlapping phrase hits per document, best of each overlap kept."""
    hits = tagger.tag_terms(t.documents, bigrams(t), "text", "term", ("doc_id",)).select(
        "doc_id", "start", "end", (F.length("term") / 100.0).alias("score"), F.col("start").alias("seq")
    )
    kept = E.fuse_overlaps(hits, ("doc_id",), 0.2)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))


# ---------------------------------------------------------------- negation
CUES = {
    "fr": negation.Cues(["pas de", "pas", "avec le", "sans"], ["est", "pour la"], ["pas la", "dans le"], ["que", "qui", "mais"]),
    "en": negation.Cues(["with the", "not", "by", "was"], ["is", "are"], ["was the", "by the"], ["that", "but"]),
}
TARGETS = {"fr": ["eau", "les", "aile", "une"], "en": ["this", "for", "and", "hand"]}


def _cue_values() -> str:
    rows = []
    for lang, c in CUES.items():
        for kind, cues in (("pre", c.pre), ("post", c.post), ("pseudo", c.pseudo)):
            rows += [f"('{lang}','{kind}',{i},'{x}',{2 * len(x.split()) - 1},{len(x.split())})" for i, x in enumerate(cues)]
    return ",".join(rows)


_NEG_SQL = f"""
WITH cues(lang, kind, ord, cue, m, words) AS (VALUES {_cue_values()}),
targets(lang, w) AS (VALUES ('fr','eau'),('fr','les'),('fr','aile'),('fr','une'),('en','this'),('en','for'),('en','and'),('en','hand')),
s AS (SELECT doc_id, lang, unnest(ss) AS sent, generate_subscripts(ss, 1) AS sid FROM
   (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS lang, regexp_extract_all(text, '{SQL_SENTENCE}') AS ss FROM documents)),
p AS (SELECT doc_id, lang, sid, regexp_extract_all(lower(sent), '{SQL_PIECES}') AS ps FROM s),
m AS (SELECT doc_id, lang, sid, ps, unnest(list_filter(range(1, len(ps) + 1), lambda i: ps[i] IN ('eau','les','aile','une','this','for','and','hand'))) AS i FROM p),
mm AS (SELECT m.* FROM m JOIN targets t ON m.lang = t.lang AND m.ps[m.i] = t.w),
j AS (SELECT mm.*, c.kind, c.ord, c.cue, c.m AS cm, c.words,
   list_filter(range(1, len(ps) - c.m + 2), lambda j: array_to_string(ps[j:j + c.m - 1], '') = c.cue) AS js
   FROM mm JOIN cues c ON mm.lang = c.lang),
v AS (SELECT doc_id, sid, i, kind, ord, cue, words,
   CASE kind
     WHEN 'pseudo' THEN len(list_filter(js, lambda x: x + cm - 1 < i)) > 0
     WHEN 'pre' THEN len(list_filter(js, lambda x: x + cm - 1 < i
        AND len(list_filter(string_split_regex(array_to_string(ps[x + cm:i - 1], ''), '\\s+'), lambda y: y <> '')) <= 6
        AND len(list_filter(ps[x + cm:i - 1], lambda y: CASE WHEN lang = 'fr' THEN y IN ('que','qui','mais') ELSE y IN ('that','but') END)) = 0)) > 0
     ELSE len(list_filter(list_filter(js, lambda x: x > i)[1:1], lambda x:
        len(list_filter(string_split_regex(array_to_string(ps[i + 1:x - 1], ''), '\\s+'), lambda y: y <> '')) <= 6
        AND len(list_filter(ps[i + 1:x - 1], lambda y: CASE WHEN lang = 'fr' THEN y IN ('que','qui','mais') ELSE y IN ('that','but') END)) = 0)) > 0
   END AS ok FROM j),
a AS (SELECT doc_id, sid, i, bool_or(ok) FILTER (kind = 'pseudo') AS pseudo,
   arg_min(cue, ord) FILTER (ok AND kind = 'pre') AS pre, arg_min(words, ord) FILTER (ok AND kind = 'pre') AS pre_n,
   arg_min(cue, ord) FILTER (ok AND kind = 'post') AS post, arg_min(words, ord) FILTER (ok AND kind = 'post') AS post_n
   FROM v GROUP BY doc_id, sid, i),
f AS (SELECT doc_id, sid, i, CASE WHEN NOT pseudo THEN coalesce(pre, post) END AS cue,
   CASE WHEN pseudo THEN NULL WHEN pre IS NOT NULL THEN 'pre' WHEN post IS NOT NULL THEN 'post' END AS kind,
   CASE WHEN pre IS NOT NULL THEN pre_n ELSE post_n END AS n FROM a)
"""


def negated_mentions(t: Tables) -> DataFrame:
    """Mentions of target words per sentence with negation columns."""
    # Every language but French is routed to English, as in P2.
    routed = F.when(F.col("lang") == "fr", "fr").otherwise("en").alias("lang")
    sents = segments.sentences(t.documents.select("doc_id", routed, "text"), "text", ("doc_id", "lang")).drop("start", "end")
    rows = [(lang, w) for lang, ws in TARGETS.items() for w in ws]
    table = literal_table(t.spark, rows, "language string, term string")
    lexicon = table.select("term").distinct()
    found = tagger.tag_terms(
        sents.withColumnRenamed("lang", "language"), lexicon, "sentence", "term", ("doc_id", "language", "sentence_id", "sentence"),
        [(True, 1)],
    )
    hits = lookup_join(found, table, ["language", "term"], "left_semi")
    around = hits.withColumn("before", F.substring("sentence", F.lit(1), F.col("start"))).withColumn(
        "after", F.substring("sentence", F.col("end") + 1, F.length("sentence"))
    )
    return around


@query(
    "negation_scope",
    _NEG_SQL
    + """SELECT doc_id, coalesce(kind, 'none') AS negation_type, coalesce(cue, '') AS negation_cue, count(*) AS n,
  CAST(round(sum(CASE WHEN kind IS NULL THEN 0.0 ELSE round(greatest(0.5, 1.0 - n * 0.08) * CASE kind WHEN 'pre' THEN 1.0 ELSE 0.92 END, 3) END), 2) AS DOUBLE) AS confidence
  FROM f GROUP BY ALL""",
)
def negation_scope(t: Tables) -> DataFrame:
    """V1 - V5."""
    rows = negation.assert_negation(negated_mentions(t), "language", cues=CUES)
    return rows.groupBy(
        "doc_id", F.coalesce("negation_type", F.lit("none")).alias("negation_type"),
        F.coalesce("negation_cue", F.lit("")).alias("negation_cue"),
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("negation_confidence"), 2).alias("confidence"))


@query(
    "negation_verified",
    _NEG_SQL
    + """, r AS (SELECT doc_id, kind, round(greatest(0.5, 1.0 - n * 0.08) * CASE kind WHEN 'pre' THEN 1.0 ELSE 0.92 END, 3) AS rule,
    CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE CAST(doc_id % 7 AS DOUBLE) / 10 END AS score FROM f WHERE kind IS NOT NULL)
  SELECT CASE WHEN rule BETWEEN 0.5 AND 0.85 AND score >= 0 THEN 'negex+nli' ELSE 'negex' END AS negation_method,
    CAST(round(CASE WHEN rule BETWEEN 0.5 AND 0.85 AND score >= 0 THEN rule * CAST(0.4 AS DOUBLE) + score * CAST(0.6 AS DOUBLE) ELSE rule END, 3) AS DOUBLE) AS negation_confidence,
    count(*) AS n FROM r GROUP BY ALL""",
)
def negation_verified(t: Tables) -> DataFrame:
    """V6: a verifier score moves doubtful confidences and never un-negates."""
    scored = negated_mentions(t).withColumn(
        "nli", F.when(F.col("doc_id") % 3 == 0, -1.0).otherwise((F.col("doc_id") % 7) / 10)
    )
    rows = negation.assert_negation(scored, "language", "nli", CUES).where("negated")
    return rows.groupBy("negation_method", "negation_confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sentence_lookup",
    f"""
WITH p AS (SELECT conv_id, turn, text, instr(lower(text), 'tion') - 1 AS s, regexp_extract_all(text, '{SQL_SENTENCE}') AS ss FROM conversations),
q AS (SELECT conv_id, turn, s, unnest(ss) AS sent, unnest(list_transform(range(1, len(ss) + 1), lambda i: length(array_to_string(ss[1:i - 1], '')))) AS st FROM p WHERE s >= 0)
SELECT conv_id, turn, s - st AS before_chars, length(sent) - (s - st) - 4 AS after_chars FROM q WHERE st <= s AND s < st + length(sent)""",
)
def sentence_lookup(t: Tables) -> DataFrame:
    """V7 by first occurrence of the mention."""
    src = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), "conv_id", "turn", F.col("text").alias("clean_text"))
    m = src.where(F.contains(F.lower("clean_text"), F.lit("tion"))).select("note_id", "conv_id", "turn", F.lit("tion").alias("text"))
    out = negation.locate_sentence(m.withColumn("start", F.lit(0)), src, "clean_text", True)
    return out.select("conv_id", "turn", F.length("before").alias("before_chars"), F.length("after").alias("after_chars"))
