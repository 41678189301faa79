"""Queries over lexicons, matching levels, vectors and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave import fixed_values as V
from chartweave.operators import lexicon as L
from chartweave.operators import normalize as N
from chartweave.operators import vectors as VEC
from chartweave.plans.registry import Tables, query
from chartweave.scale import literal_table
from chartweave.plans.text_queries import sql_list


# -------------------------------------------------------- lexicons from parts
def concepts(t: Tables) -> DataFrame:
    """Every part is a concept: its name the label, with two kinds of synonyms."""
    return t.part.select(
        F.concat(F.lit("C:"), "p_partkey").alias("id"),
        F.initcap("p_name").alias("name"),
        F.lit("").alias("definition"),
        F.array(F.concat_ws(" ", F.lower("p_type"), "p_name"), F.concat_ws(" ", "p_name", F.lower("p_brand"))).alias("exact_synonyms"),
        F.array(F.concat_ws(" ", F.lit("size"), "p_size"), F.col("p_name")).alias("related_synonyms"),
        F.array(F.concat(F.lit("UMLS:"), "p_brand"), F.concat(F.lit("OTHER:"), "p_type"), F.concat(F.lit("UMLS:"), "p_type")).alias("xrefs"),
        F.col("p_partkey").alias("ord"),
    )


def curated(t: Tables) -> DataFrame:
    """Curated terms from nations; one of them also is a part name."""
    return t.nation.select(
        F.when(F.col("n_nationkey") == 0, "red plate").otherwise(F.lower("n_name")).alias("term"),
        F.concat(F.lit("N:"), "n_nationkey").alias("concept_id"), F.col("n_name").alias("name"),
    )


_LOOKUP_SQL = """
con AS (SELECT 'C:' || p_partkey AS id, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name,
   lower(p_type) || ' ' || p_name AS e1, p_name || ' ' || lower(p_brand) AS e2, 'size ' || p_size AS r1, p_name AS r2, p_partkey AS ord FROM part),
al AS (
  SELECT CASE WHEN n_nationkey = 0 THEN 'red plate' ELSE lower(n_name) END AS term, 'N:' || n_nationkey AS concept_id, n_name AS name, 'clinical_synonym' AS match_type, 0 AS a, 0 AS b, 0 AS c, 0 AS d FROM nation
  UNION ALL SELECT lower(name), id, name, 'exact_label', 1, -ord, 0, 0 FROM con
  UNION ALL SELECT e1, id, name, 'exact_synonym', 2, ord, 0, 0 FROM con
  UNION ALL SELECT e2, id, name, 'exact_synonym', 2, ord, 0, 1 FROM con
  UNION ALL SELECT r1, id, name, 'related_synonym', 2, ord, 1, 0 FROM con
  UNION ALL SELECT r2, id, name, 'related_synonym', 2, ord, 1, 1 FROM con),
lookup AS (SELECT term, concept_id, name, match_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY a, b, c, d, concept_id) AS rn FROM al) WHERE rn = 1)
"""


@query("lookup_build", f"WITH {_LOOKUP_SQL} SELECT lower(term) AS term, concept_id, name, match_type FROM lookup")
def lookup_build(t: Tables) -> DataFrame:
    """N2."""
    return L.build_lookup(concepts(t), curated(t))


def phrases(t: Tables) -> DataFrame:
    """Entity texts written from parts: exact, inside a longer phrase, abbreviated, unknown."""
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.upper("p_name"))
        .when(k == 1, F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
        .when(k == 2, F.concat(F.lit("very "), F.col("p_name"), F.lit(" today")))
        .when(k == 3, F.concat_ws(" ", F.lit("old"), F.lower("p_type"), F.col("p_name"), F.lower("p_brand")))
        .when(k == 4, F.lower("p_type"))
        .otherwise(F.concat(F.lit("size "), "p_size"))
    )
    return t.part.select("p_partkey", text.alias("text"), F.lit("en").alias("language"))


_PHRASES_SQL = """
ph AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN 'very ' || p_name || ' today'
  WHEN 3 THEN 'old ' || lower(p_type) || ' ' || p_name || ' ' || lower(p_brand) WHEN 4 THEN lower(p_type) ELSE 'size ' || p_size END AS text FROM part)
"""
_BLACK = ["C:" + str(i) for i in (1, 5, 7)] + ["N:0"]


def blacklist(t: Tables) -> DataFrame:
    return L.blacklist_table(t.spark, _BLACK)


_OK_SQL = f"ok AS (SELECT lower(term) AS term, concept_id, name, match_type FROM lookup WHERE concept_id NOT IN ({sql_list(_BLACK)[1:-1]}))"


@query(
    "exact_match",
    f"WITH {_LOOKUP_SQL}, {_PHRASES_SQL}, {_OK_SQL} SELECT p_partkey, concept_id AS id, match_type, CAST(CASE WHEN concept_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence "
    "FROM ph LEFT JOIN ok ON trim(lower(text)) = term",
)
def exact_match(t: Tables) -> DataFrame:
    """N3."""
    lookup = L.allowed(L.build_lookup(concepts(t), curated(t)), blacklist(t))
    hit = L.match_exact(phrases(t), lookup, "text")
    return hit.select("p_partkey", "exact.id", "exact.match_type", F.coalesce("exact.confidence", F.lit(0.0)).alias("confidence"))


_SUB_SQL = """
w AS (SELECT p_partkey, list_filter(string_split(trim(lower(text)), ' '), lambda x: x <> '') AS ws FROM ph),
g AS (SELECT p_partkey, s, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase FROM w, range(1, 12) a(s), range(2, 12) b(n)
      WHERE len(ws) >= 3 AND n < len(ws) AND s + n - 1 <= len(ws)),
sub AS (SELECT p_partkey, arg_min(concept_id, -n * 1000 + s) AS id FROM g JOIN ok ON g.phrase = ok.term GROUP BY p_partkey)
"""


@query(
    "subphrase_match",
    f"WITH {_LOOKUP_SQL}, {_PHRASES_SQL}, {_OK_SQL}, {_SUB_SQL} SELECT p_partkey, id, CAST(0.95 AS DOUBLE) AS confidence FROM sub",
)
def subphrase_match(t: Tables) -> DataFrame:
    """N4."""
    lookup = L.allowed(L.build_lookup(concepts(t), curated(t)), blacklist(t))
    sub = L.match_subphrase(phrases(t), lookup, "text", "p_partkey")
    return sub.select("p_partkey", "sub.id", "sub.confidence")


@query(
    "abbreviation_expand",
    """
WITH e AS (SELECT event_id, event_type AS text, CASE WHEN user_id % 2 = 0 THEN 'fr' ELSE 'en' END AS language FROM events),
a(key, expansion, lang) AS (VALUES ('click', 'clic souris', 'fr'), ('click', 'mouse click', 'en'), ('view', 'vue', 'fr'), ('error', 'any error', NULL), ('view', 'any view', NULL)),
x AS (SELECT e.*, (SELECT arg_min(expansion, CASE WHEN a.lang = e.language THEN 0 WHEN a.lang IS NOT NULL THEN 1 ELSE 2 END) FROM a WHERE a.key = e.text) AS ex FROM e)
SELECT text, language, coalesce(ex, text) AS expanded_text, count(*) AS n FROM x GROUP BY ALL""",
)
def abbreviation_expand(t: Tables) -> DataFrame:
    """N1."""
    e = t.events.select("event_id", F.col("event_type").alias("text"), F.when(F.col("user_id") % 2 == 0, "fr").otherwise("en").alias("language"))
    table = literal_table(t.spark, 
        [("click", "clic souris", "fr", 0), ("click", "mouse click", "en", 0), ("view", "vue", "fr", 0), ("error", "any error", None, 0), ("view", "any view", None, 0)],
        "key string, expansion string, lang string, priority int",
    )
    return L.expand_abbreviations(e, table).groupBy("text", "language", "expanded_text").agg(F.count(F.lit(1)).alias("n"))


def _bilingual(t: Tables) -> DataFrame:
    own = literal_table(t.spark, 
        [("red plate", "F:1", "Plate"), ("rod", "F:2", "Rod"), ("promo", None, None), ("hot", "F:3", "Hot")],
        "term string, concept_id string, name string",
    )
    official = t.part.select(F.col("p_name").alias("term")).distinct().select(
        "term", F.concat(F.lit("O:"), "term").alias("concept_id"), F.col("term").alias("name")
    ).unionByName(literal_table(t.spark, [("ring", "O:ring", "ring"), ("hot rod", "O:hr", "hr")], "term string, concept_id string, name string"))
    return L.bilingual_table(own, official)


def _bilingual_sql(contains: str) -> str:
    return f"""
WITH {_PHRASES_SQL}, own(term, id, p) AS (VALUES ('red plate', 'F:1', 0), ('rod', 'F:2', 0), ('promo', NULL, 0), ('hot', 'F:3', 0)),
off AS (SELECT DISTINCT p_name AS term, 'O:' || p_name AS id, 1 AS p FROM part UNION ALL VALUES ('ring', 'O:ring', 1), ('hot rod', 'O:hr', 1)),
tab AS (SELECT term, id, p FROM (SELECT *, row_number() OVER (PARTITION BY term, p ORDER BY id) AS rn FROM (SELECT * FROM own UNION ALL SELECT * FROM off)) WHERE rn = 1),
k AS (SELECT p_partkey, trim(lower(text)) AS k FROM ph),
whole AS (SELECT p_partkey, min(p) AS p, arg_min(coalesce(id, 'REJECT'), p) AS id FROM k JOIN tab ON k.k = tab.term GROUP BY p_partkey),
part_hit AS (SELECT p_partkey, arg_min(id, (-length(term), p, term)) AS id FROM k JOIN tab ON {contains} AND length(term) >= 4 AND id IS NOT NULL GROUP BY p_partkey)
SELECT k.p_partkey, CASE WHEN whole.id = 'REJECT' THEN NULL ELSE coalesce(whole.id, part_hit.id) END AS id,
  CASE WHEN whole.id = 'REJECT' THEN 'rejected' WHEN whole.p = 0 THEN 'french_curated' WHEN whole.p = 1 THEN 'french_orphanet' WHEN part_hit.id IS NOT NULL THEN 'french_partial' ELSE 'none' END AS match_type
FROM k LEFT JOIN whole USING (p_partkey) LEFT JOIN part_hit USING (p_partkey)"""


def _bilingual_match(t: Tables, compat: bool) -> DataFrame:
    rows = phrases(t)
    m = L.match_bilingual(rows, _bilingual(t), "text", "p_partkey", compat)
    out = rows.select("p_partkey").join(m, "p_partkey", "left")
    return out.select(
        "p_partkey", "fr.id",
        F.when(F.col("rejected"), "rejected").otherwise(F.coalesce("fr.match_type", F.lit("none"))).alias("match_type"),
    )


@query("bilingual_match", _bilingual_sql("contains(' ' || k.k || ' ', ' ' || tab.term || ' ')"))
def bilingual_match(t: Tables) -> DataFrame:
    """N5 with word-bounded containment."""
    return _bilingual_match(t, False)


@query("bilingual_contains", _bilingual_sql("contains(k.k, tab.term)"))
def bilingual_contains(t: Tables) -> DataFrame:
    """N5 with plain containment, as an equality join on substrings."""
    return _bilingual_match(t, True)


@query(
    "translate_terms",
    """
SELECT p_partkey, coalesce(CASE lower(p_type) WHEN 'promo' THEN 'special' WHEN 'small' THEN 'little' END,
  CASE lower(p_type) WHEN 'small' THEN 'tiny' WHEN 'large' THEN 'big' END, p_type) AS translated FROM part""",
)
def translate_terms(t: Tables) -> DataFrame:
    """N6."""
    table = literal_table(t.spark, 
        [("promo", "special", 0), ("small", "little", 0), ("small", "tiny", 1), ("large", "big", 1)],
        "term string, english string, priority int",
    )
    return L.translate(t.part.select("p_partkey", "p_type"), table, "p_type").select("p_partkey", "translated")


@query(
    "xref_enrich",
    f"""
WITH {_LOOKUP_SQL}, {_PHRASES_SQL}, {_OK_SQL} SELECT ph.p_partkey, id, CASE WHEN id LIKE 'C:%' THEN p_brand END AS umls_cui FROM
 (SELECT p_partkey, concept_id AS id FROM ph LEFT JOIN ok ON trim(lower(text)) = term) ph LEFT JOIN part p ON ph.id = 'C:' || p.p_partkey""",
)
def xref_enrich(t: Tables) -> DataFrame:
    """N13, concept to external id."""
    lookup = L.allowed(L.build_lookup(concepts(t), curated(t)), blacklist(t))
    hit = L.match_exact(phrases(t), lookup, "text").select("p_partkey", "exact.id")
    return L.enrich_xrefs(hit, concepts(t), "id")


@query(
    "xref_reverse",
    """
SELECT external_id, 'C:' || min(p_partkey) AS concept_id FROM
 (SELECT p_brand AS external_id, p_partkey FROM part UNION ALL SELECT p_type, p_partkey FROM part) GROUP BY external_id""",
)
def xref_reverse(t: Tables) -> DataFrame:
    """N13, external id to its first concept."""
    return L.reverse_xref(concepts(t))


@query(
    "prefilter",
    f"""
WITH w AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS text FROM conversations),
e AS (SELECT text, CASE role WHEN 'user' THEN 'problem' WHEN 'assistant' THEN 'treatment' ELSE 'test' END AS category,
  CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, (turn % 10) / 10.0 AS score FROM w),
s AS (SELECT category, lang, CASE WHEN lang = 'en' AND lower(text) IN ({sql_list(V.NOISE_WORDS_EN)[1:-1]}) THEN 'skipped_en_noise'
  WHEN lang = 'en' AND length(text) <= 3 THEN 'skipped_too_short' WHEN lang = 'en' AND score < 0.55 THEN 'skipped_low_ner_score'
  WHEN category IN ('treatment', 'test') THEN 'skipped_' || category
  WHEN lang = 'fr' AND category = 'problem' AND (lower(text) IN ({sql_list(V.QUALIFIERS_FR)[1:-1]}) OR contains(lower(text), 'bilan d') OR contains(lower(text), 'examen d') OR length(text) <= 2) THEN 'skipped_qualifier_fr'
  ELSE 'kept' END AS match_type FROM e)
SELECT category, lang, match_type, count(*) AS n FROM s GROUP BY ALL""",
)
def prefilter(t: Tables) -> DataFrame:
    """N10."""
    w = t.conversations.select(
        "conv_id", "turn", "role", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("text")
    ).select(
        "text", F.when(F.col("role") == "user", "problem").when(F.col("role") == "assistant", "treatment").otherwise("test").alias("category"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("fr").alias("lang"), ((F.col("turn") % 10) / 10).alias("score"),
    )
    reason = N.skip_reason(F.col("text"), F.col("score"), F.col("category"), F.col("lang"))
    return w.groupBy("category", "lang", F.coalesce(reason, F.lit("kept")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


def _entities(t: Tables) -> DataFrame:
    return phrases(t).withColumn("category", F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("problem")).withColumn(
        "score", F.when(F.col("p_partkey") % 7 == 0, 0.5).otherwise(0.9)
    )


_CASCADE_SQL = f"""
WITH {_LOOKUP_SQL}, {_PHRASES_SQL}, {_OK_SQL}, {_SUB_SQL},
r AS (SELECT ph.p_partkey, ph.text, ok.concept_id AS e, ok.match_type AS et, sub.id AS s,
  CASE WHEN ph.p_partkey % 7 = 0 THEN 'skipped_low_ner_score' WHEN ph.p_partkey % 5 = 0 THEN 'skipped_test' END AS skip
  FROM ph LEFT JOIN ok ON trim(lower(ph.text)) = ok.term LEFT JOIN sub USING (p_partkey)),
c AS (SELECT p_partkey, CASE WHEN skip IS NULL THEN coalesce(e, s) END AS hpo_id,
  CASE WHEN skip IS NOT NULL THEN skip WHEN e IS NOT NULL THEN et WHEN s IS NOT NULL THEN 'substring_match' ELSE 'no_match' END AS match_type,
  CAST(CASE WHEN skip IS NOT NULL THEN 0.0 WHEN e IS NOT NULL THEN 1.0 WHEN s IS NOT NULL THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence FROM r)
"""


@query("match_cascade", _CASCADE_SQL + "SELECT p_partkey, hpo_id, match_type, confidence, hpo_id IS NOT NULL AS matched FROM c")
def match_cascade(t: Tables) -> DataFrame:
    """N10 - N11 on distinct texts, joined back."""
    dims = N.Dictionaries(L.build_lookup(concepts(t), curated(t)), blacklist=blacklist(t))
    rows = N.normalize_entities(_entities(t), dims)
    return rows.select("p_partkey", "hpo_id", "match_type", "confidence", "matched")


@query(
    "cascade_vectors",
    """
WITH unit AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
d AS (SELECT label, i, avg(v[i]) AS m FROM unit, range(1, 65) r(i) GROUP BY label, i),
cen AS (SELECT label, list(m ORDER BY i) AS c FROM d GROUP BY label),
s AS (SELECT vec_id, cen.label, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) AS sim FROM unit, cen),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s),
a AS (SELECT vec_id, max(label) FILTER (rn = 1) AS label, max(sim) FILTER (rn = 1) AS s1, max(sim) FILTER (rn = 2) AS s2 FROM r GROUP BY vec_id)
SELECT vec_id, CASE WHEN NOT ok THEN 'no_match' WHEN one AND s1 < 0.80 THEN 'sapbert_rejected_low_conf' ELSE 'sapbert_similarity' END AS match_type,
  CASE WHEN ok AND NOT (one AND s1 < 0.80) THEN 'L' || label END AS hpo_id
FROM (SELECT *, s1 >= 0.5 OR (s1 - s2 > 0.18 AND s1 >= 0.62) AS ok, vec_id % 2 = 0 AS one FROM a)""",
)
def cascade_vectors(t: Tables) -> DataFrame:
    """N11 + N12: the vector level of the cascade, with the one-word veto."""
    index = VEC.centroids(t.embeddings.select(F.concat(F.lit("L"), "label").alias("concept_id"), F.col("embedding").alias("vec")))
    word = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("word"), "vec_id")).otherwise(F.concat(F.lit("two words"), "vec_id"))
    ents = t.embeddings.select("vec_id", word.alias("text"), F.lit("problem").alias("category"), F.lit(0.9).alias("score"), F.lit("en").alias("language"))
    empty = literal_table(t.spark, [("nothing else", "Z", "z", "exact_label")], "term string, concept_id string, name string, match_type string")
    dims = N.Dictionaries(
        empty, concept_vectors=index.withColumn("name", F.col("concept_id")),
        text_vectors=t.embeddings.select(word.alias("text"), F.col("embedding").alias("vec")), tau=0.5,
    )
    return N.normalize_entities(ents, dims).select("vec_id", "match_type", "hpo_id")


@query(
    "best_per_concept",
    """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_discount,
   row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_discount DESC, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE WHEN rn = 1 THEN l_partkey END AS hpo_id,
  CASE WHEN rn = 1 THEN 'exact_label' ELSE 'deduplicated' END AS match_type, rn = 1 AS matched FROM r""",
)
def best_per_concept(t: Tables) -> DataFrame:
    """N14 over order lines: no window, so a hot order or part cannot stall a task."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_partkey").alias("hpo_id"),
        F.col("l_discount").alias("confidence"), F.lit("exact_label").alias("match_type"), F.lit(True).alias("matched"),
    )
    out = N.dedup_concepts(rows, ("l_orderkey",), order=("l_linenumber", "l_suppkey", "l_extendedprice"))
    return out.drop("confidence")


@query(
    "match_stats",
    """
SELECT l_orderkey AS note_id, count(*) AS total, count(*) FILTER (l_returnflag <> 'N') AS matched, count(*) FILTER (l_returnflag = 'N') AS unmatched,
  round(CAST(count(*) FILTER (l_returnflag <> 'N') AS DOUBLE) / count(*) * 100, 1) AS match_rate,
  count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS unique_hpo FROM lineitem GROUP BY l_orderkey""",
)
def match_stats(t: Tables) -> DataFrame:
    """N15."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("note_id"), (F.col("l_returnflag") != "N").alias("matched"), F.col("l_partkey").alias("hpo_id")
    )
    return N.match_stats(rows)


@query(
    "fuzzy_match",
    """
WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(text), 'éèêàâäùûüïîôöçñóíáúß', 'eeeaaauuuiioocnoiaus'), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
w AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(text), 'éèêàâäùûüïîôöçñóíáúß', 'eeeaaauuuiioocnoiaus'), '[\\p{L}\\p{N}_]+')) AS k FROM conversations),
j AS (SELECT k, term, levenshtein(k, term) AS e FROM w JOIN lex ON abs(length(k) - length(term)) <= 1)
SELECT k, min(e) AS edits, arg_min(term, (e, term)) AS name FROM j WHERE e <= 1 GROUP BY k""",
)
def fuzzy_match(t: Tables) -> DataFrame:
    """N16 on the distinct words of the conversations."""
    low = F.translate(F.lower("text"), "éèêàâäùûüïîôöçñóíáúß", "eeeaaauuuiioocnoiaus")
    run = lambda d: d.select(F.explode(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("k")).distinct()
    lex = run(t.benchmark).select(F.col("k").alias("term"), F.col("k").alias("concept_id"), F.col("k").alias("name"))
    return L.match_fuzzy(run(t.conversations).withColumn("id", F.col("k")), lex, "k", "id").select(
        F.col("id").alias("k"), "edits", "name"
    )


# ------------------------------------------------------------------ vectors
_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
_CENTROID_SQL = f"""
WITH unit AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
d AS (SELECT label, i, avg(v[i]) AS m FROM unit, range(1, 65) r(i) GROUP BY label, i),
c0 AS (SELECT label, list(m ORDER BY i) AS c FROM d GROUP BY label),
cen AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM c0)
"""


@query(
    "centroids",
    _CENTROID_SQL + "SELECT label, i - 1 AS dim, round(c[i], 4) + 0.0 AS x FROM cen, range(1, 65) r(i)",
)
def centroids(t: Tables) -> DataFrame:
    """N7."""
    c = VEC.centroids(t.embeddings, "label", "embedding")
    return c.select("label", F.posexplode("vec").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), (F.round("x", 4) + 0.0).alias("x"))


@query(
    "vector_link",
    _CENTROID_SQL
    + """, s AS (SELECT vec_id, cen.label, list_inner_product(v, c) AS sim FROM unit, cen),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s),
  a AS (SELECT vec_id, max(label) FILTER (rn = 1) AS concept_id, max(sim) FILTER (rn = 1) AS s1, max(sim) FILTER (rn = 2) AS s2,
        max(sim) FILTER (rn = 3) AS s3 FROM r GROUP BY vec_id)
  SELECT vec_id, concept_id, round(s1, 4) AS confidence, round(s1 - s2, 4) AS margin, s1 >= 0.70 OR (s1 - s2 > 0.18 AND s1 >= 0.62) AS accepted,
    round(s3, 4) AS third FROM a""",
)
def vector_link(t: Tables) -> DataFrame:
    """All vectors against the concept centroids."""
    index = VEC.centroids(t.embeddings.select(F.col("label").alias("concept_id"), F.col("embedding").alias("vec")))
    out = VEC.link_vectors(t.embeddings.select("vec_id", "embedding"), index, "vec_id", "embedding")
    return out.select("vec_id", "concept_id", "confidence", "margin", "accepted", F.get("alternatives", F.lit(2))["score"].alias("third"))


@query(
    "vector_search",
    _CENTROID_SQL
    + """, s AS (SELECT a.vec_id, b.vec_id AS concept_id, list_inner_product(a.v, b.v) AS sim FROM unit a, unit b),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, concept_id) AS rank FROM s)
  SELECT vec_id, concept_id, round(sim, 4) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
)
def vector_search(t: Tables) -> DataFrame:
    """The five nearest of all vectors for each of them, by inverted lists."""
    index = VEC.build_lists(t.embeddings.select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vec")))
    found = VEC.search_lists(t.embeddings, index, "vec_id", "embedding", 5)
    return found.select("vec_id", "concept_id", F.round("similarity", 4).alias("similarity"), "rank")
