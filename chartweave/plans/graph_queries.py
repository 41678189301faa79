"""Queries over ontology graphs and disease ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import ontology as G
from chartweave.operators import ranking as R
from chartweave.operators import upkeep
from chartweave.plans.registry import Tables, query
from chartweave.plans.text_queries import BIGRAM_SQL, bigrams
from chartweave.scale import literal_table, lookup_join
from chartweave.session import materialise

# A part's leaf concept is its brand and type; both are its parents (a diamond
# under one root). Orders are patients with the leaves of their lines, nations are
# diseases with their twelve most over-represented leaves.
_LEAF = "p_brand || '/' || p_type"


def edges(t: Tables) -> DataFrame:
    p = t.part
    leaf = F.concat_ws("/", "p_brand", "p_type")
    return (
        p.select(leaf.alias("child"), F.col("p_brand").alias("parent"))
        .union(p.select(leaf, "p_type"))
        .union(p.select("p_brand", F.lit("root")))
        .union(p.select("p_type", F.lit("root")))
        .distinct()
    )


_EDGES_SQL = f"""
edges AS (SELECT DISTINCT {_LEAF} AS child, p_brand AS parent FROM part UNION SELECT DISTINCT {_LEAF}, p_type FROM part
  UNION SELECT DISTINCT p_brand, 'root' FROM part UNION SELECT DISTINCT p_type, 'root' FROM part),
closure(term, ancestor) AS (SELECT child, parent FROM edges UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges
  UNION SELECT c.term, e.parent FROM closure c JOIN edges e ON c.ancestor = e.child)
"""


@query("ancestor_closure", f"WITH RECURSIVE {_EDGES_SQL} SELECT term, ancestor FROM closure")
def ancestor_closure(t: Tables) -> DataFrame:
    """G1 on a DAG with diamonds."""
    return G.ancestor_closure(edges(t))


@query(
    "geo_closure",
    """
WITH RECURSIVE e(child, parent) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region),
c(term, ancestor) AS (SELECT child, parent FROM e UNION SELECT child, child FROM e UNION SELECT parent, parent FROM e
  UNION SELECT c.term, e.parent FROM c JOIN e ON c.ancestor = e.child)
SELECT term, ancestor FROM c""",
)
def geo_closure(t: Tables) -> DataFrame:
    """G1 on the geographic hierarchy, four levels."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = (
        t.customer.select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent"))
        .union(t.supplier.select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
        .union(t.nation.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
        .union(t.region.select(tag("r", "r_regionkey"), F.lit("world")))
    )
    return G.ancestor_closure(e)


@query(
    "bounded_ancestors",
    """
WITH e(child, parent) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'r' || r_regionkey, 'world' FROM region)
SELECT child AS term, parent AS ancestor FROM e WHERE parent <> 'world'
UNION SELECT a.child, b.parent FROM e a JOIN e b ON a.parent = b.child WHERE b.parent <> 'world'""",
)
def bounded_ancestors(t: Tables) -> DataFrame:
    """G2."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = (
        t.customer.select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent"))
        .union(t.nation.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
        .union(t.region.select(tag("r", "r_regionkey"), F.lit("world")))
    )
    return G.bounded_ancestors(e, 2, "world")


def order_leaves(t: Tables) -> DataFrame:
    """Distinct ``(note_id, concept_id)``: leaves of an order's lines."""
    leaf = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("concept_id"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("note_id"), "l_partkey", "l_suppkey")
    return lines.join(leaf, "l_partkey").select("note_id", "concept_id", "l_suppkey")


def profiles(t: Tables) -> DataFrame:
    """Nation profiles: every leaf that the nation's lines hold more often than an
    average nation's do."""
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("disease_id"))
    counts = lookup_join(order_leaves(t), s, "l_suppkey").groupBy("disease_id", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("concept_id").agg(F.sum("n").alias("all"))
    nations = counts.agg(F.count_distinct("disease_id").alias("nations"))
    held = counts.join(totals, "concept_id").join(F.broadcast(nations)).where(F.col("n") * F.col("nations") > F.col("all"))
    names = t.nation.select(F.col("n_nationkey").cast("string").alias("disease_id"), F.col("n_name").alias("name"))
    return lookup_join(held, names, "disease_id").select("disease_id", "name", "concept_id")


_PROFILES_SQL = f"""
ol AS (SELECT l_orderkey AS note_id, {_LEAF} AS concept_id, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
cn AS (SELECT CAST(s_nationkey AS VARCHAR) AS disease_id, concept_id, count(*) AS n FROM ol JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
tot AS (SELECT concept_id, sum(n) AS a FROM cn GROUP BY ALL),
profiles AS (SELECT disease_id, concept_id FROM cn JOIN tot USING (concept_id) WHERE n * (SELECT count(DISTINCT disease_id) FROM cn) > a),
reach AS (SELECT DISTINCT disease_id, ancestor FROM profiles JOIN closure ON concept_id = term),
tn AS (SELECT count(DISTINCT disease_id) AS t FROM profiles),
ic AS (SELECT ancestor AS concept_id, count(*) AS n, CASE WHEN count(*) < max(t) THEN -log2(CAST(count(*) AS DOUBLE) / max(t)) ELSE 0.0 END AS ic FROM reach, tn GROUP BY ancestor)
"""


@query(
    "information_content",
    f"WITH RECURSIVE {_EDGES_SQL}, {_PROFILES_SQL} SELECT concept_id, n, CAST(round(ic, 6) AS DOUBLE) AS ic FROM ic",
)
def information_content(t: Tables) -> DataFrame:
    """G3."""
    ic = G.information_content(profiles(t), G.ancestor_closure(edges(t)))
    return ic.select("concept_id", "n", F.round("ic", 6).alias("ic"))


# Changes: brands ending in 1 lose their leaves' types, brands ending in 2 or 3 come
# under a new line; nations lose some leaves and gain brands of others.
def _edge_changes(t: Tables) -> DataFrame:
    line = F.concat(F.lit("line/"), F.substring("p_brand", -1, 1))
    leaf = F.concat_ws("/", "p_brand", "p_type")
    renewed = t.part.where(F.col("p_brand").rlike("[23]$"))
    return (
        t.part.where(F.col("p_brand").endswith("1")).select(leaf.alias("child"), F.col("p_type").alias("parent"), F.lit(-1).alias("sign"))
        .union(renewed.select("p_brand", line, F.lit(1))).union(renewed.select("p_brand", F.lit("root"), F.lit(-1)))
        .union(renewed.select(line, F.lit("root"), F.lit(1)))
    )


_RENEWED_SQL = f"""{_EDGES_SQL.split("closure(term")[0].replace("edges AS (", "edges0 AS (")}
edges AS (SELECT * FROM (SELECT child, parent FROM edges0 EXCEPT (SELECT {_LEAF}, p_type FROM part WHERE p_brand LIKE '%1' UNION SELECT p_brand, 'root' FROM part WHERE regexp_matches(p_brand, '[23]$')))
  UNION SELECT p_brand, 'line/' || right(p_brand, 1) FROM part WHERE regexp_matches(p_brand, '[23]$') UNION SELECT 'line/' || right(p_brand, 1), 'root' FROM part WHERE regexp_matches(p_brand, '[23]$')),
closure(term{_EDGES_SQL.split("closure(term")[1]}"""
_REPROFILED_SQL = _PROFILES_SQL.replace("profiles AS (", "profiles0 AS (").replace(
    "reach AS (",
    """profiles AS (SELECT * FROM (SELECT disease_id, concept_id FROM profiles0 EXCEPT SELECT disease_id, concept_id FROM profiles0 WHERE length(concept_id) % 3 = 0 AND disease_id LIKE '1%')
  UNION SELECT disease_id, split_part(concept_id, '/', 1) FROM profiles0 WHERE concept_id LIKE '%3/%' AND disease_id LIKE '%2'),
reach AS (""",
)


@query("closure_changes", f"WITH RECURSIVE {_RENEWED_SQL} SELECT term, ancestor FROM closure")
def closure_changes(t: Tables) -> DataFrame:
    """G1 kept up to date: the closure after added and removed edges, without a rebuild."""
    before = edges(t)
    return upkeep.update_closure(before, G.ancestor_closure(before), _edge_changes(t))[1]


@query("content_changes", f"WITH RECURSIVE {_RENEWED_SQL}, {_REPROFILED_SQL} SELECT concept_id, n, CAST(round(ic, 6) AS DOUBLE) AS ic FROM ic")
def content_changes(t: Tables) -> DataFrame:
    """G3 kept up to date: information content after changes of edges and annotations."""
    p = materialise(profiles(t).select("disease_id", "concept_id"))
    gone = p.where((F.length("concept_id") % 3 == 0) & F.col("disease_id").startswith("1")).withColumn("sign", F.lit(-1))
    added = p.where(F.col("concept_id").contains("3/") & F.col("disease_id").endswith("2")).select(
        "disease_id", F.substring_index("concept_id", "/", 1).alias("concept_id"), F.lit(1).alias("sign")
    )
    after = upkeep.Ontology.build(edges(t), p).changed(_edge_changes(t), gone.unionByName(added))
    return after.information_content().select("concept_id", "n", F.round("ic", 6).alias("ic"))


@query(
    "concept_similarity",
    f"""WITH RECURSIVE {_EDGES_SQL}, {_PROFILES_SQL}, lv AS (SELECT DISTINCT concept_id FROM profiles)
  SELECT a.concept_id AS a, b.concept_id AS b, CAST(round(max(ic.ic), 6) AS DOUBLE) AS sim FROM lv a JOIN closure ca ON ca.term = a.concept_id
  JOIN closure cb ON cb.ancestor = ca.ancestor JOIN lv b ON b.concept_id = cb.term JOIN ic ON ic.concept_id = ca.ancestor WHERE ic.ic > 0 GROUP BY ALL""",
)
def concept_similarity(t: Tables) -> DataFrame:
    """G4 over the profile concepts."""
    p = profiles(t)
    closure = G.ancestor_closure(edges(t))
    terms = p.select(F.col("concept_id").alias("term"))
    sims = G.pair_similarity(terms, terms, closure, G.information_content(p, closure))
    return sims.select("a", "b", F.round("sim", 6).alias("sim"))


RANK_SQL = f"""
WITH RECURSIVE {_EDGES_SQL}, {_PROFILES_SQL},
pt AS (SELECT DISTINCT note_id, concept_id FROM ol),
np AS (SELECT note_id, count(*) AS np FROM pt GROUP BY note_id),
nd AS (SELECT disease_id, count(*) AS nd FROM profiles GROUP BY disease_id),
lv AS (SELECT DISTINCT concept_id FROM pt UNION SELECT DISTINCT concept_id FROM profiles),
sim AS (SELECT a.concept_id AS p, b.concept_id AS d, max(ic.ic) AS s FROM lv a JOIN closure ca ON ca.term = a.concept_id
  JOIN closure cb ON cb.ancestor = ca.ancestor JOIN (SELECT DISTINCT concept_id FROM profiles) b ON b.concept_id = cb.term
  JOIN ic ON ic.concept_id = ca.ancestor GROUP BY ALL),
pd AS (SELECT note_id, disease_id, p, d, s FROM pt JOIN sim ON pt.concept_id = p JOIN profiles ON profiles.concept_id = d),
fw AS (SELECT note_id, disease_id, sum(s) AS f FROM (SELECT note_id, disease_id, p, max(s) AS s FROM pd GROUP BY ALL) GROUP BY ALL),
bk AS (SELECT note_id, disease_id, sum(s) AS b FROM (SELECT note_id, disease_id, s, row_number() OVER (PARTITION BY note_id, disease_id ORDER BY s DESC) AS rn
   FROM (SELECT note_id, disease_id, d, max(s) AS s FROM pd GROUP BY ALL)) JOIN np USING (note_id) JOIN nd USING (disease_id) WHERE rn <= least(np, nd) GROUP BY ALL),
ov AS (SELECT note_id, disease_id, count(*) AS o FROM pt JOIN profiles USING (concept_id) GROUP BY ALL),
sc AS (SELECT note_id, disease_id, coalesce(o, 0) AS matched_count, nd,
   round((CAST(0.7 AS DOUBLE) * f / np + CAST(0.3 AS DOUBLE) * b / least(np, nd)) * (1.0 / (SELECT max(ic) FROM ic)) + coalesce(o, 0) * CAST(0.02 AS DOUBLE), 4) AS score
   FROM fw JOIN bk USING (note_id, disease_id) JOIN np USING (note_id) JOIN nd USING (disease_id) LEFT JOIN ov USING (note_id, disease_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, disease_id) AS rank FROM sc)
"""


def ranked_orders(t: Tables, k: int = 10) -> DataFrame:
    model = R.disease_model(profiles(t), G.ancestor_closure(edges(t)))
    return R.rank_diseases(order_leaves(t).select("note_id", "concept_id"), model, k)


@query(
    "disease_ranking",
    RANK_SQL + "SELECT note_id, disease_id, CAST(score AS DOUBLE) AS score, matched_count, CAST(round(CAST(matched_count AS DOUBLE) / nd, 4) AS DOUBLE) AS coverage, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10",
)
def disease_ranking(t: Tables) -> DataFrame:
    """G5 + G6: every order ranked against every nation."""
    return ranked_orders(t).select("note_id", "disease_id", "score", "matched_count", "coverage", "rank")


# ------------------------------------------------------------- name mentions
def _named(t: Tables) -> DataFrame:
    """Diseases named by part names: long names and one hyphenated word each."""
    return t.part.select(
        F.concat(F.lit("D"), "p_partkey").alias("disease_id"),
        F.concat_ws(" ", "p_name", F.concat_ws("-", F.lower("p_type"), F.col("p_size").cast("string"))).alias("name"),
        F.col("p_partkey").alias("ord"),
    )


@query(
    "disease_names",
    """
WITH n AS (SELECT p_partkey, p_name || ' ' || lower(p_type) || '-' || p_size AS name, lower(p_type) || '-' || p_size AS h FROM part),
u AS (SELECT name AS term, p_partkey FROM n WHERE length(name) >= 10 UNION ALL SELECT h, p_partkey FROM n WHERE length(h) >= 8),
b AS (SELECT term, 'D' || max(p_partkey) AS disease_id FROM u GROUP BY term)
SELECT b.term, CASE WHEN b.term = 'economy-7' THEN 'DX' ELSE disease_id END AS disease_id FROM b
UNION SELECT 'economy-7', 'DX'""",
)
def disease_names(t: Tables) -> DataFrame:
    """G7."""
    aliases = literal_table(t.spark, [("Economy-7", "DX", 0)], "alias string, disease_id string, ord int")
    return R.disease_name_index(_named(t), aliases, "ord").select("term", "disease_id")


def _word_index(t: Tables) -> DataFrame:
    """Name keys that occur in the documents: phrases of the benchmark."""
    return bigrams(t).select("term", F.concat(F.lit("D:"), F.substring("term", 1, 3)).alias("disease_id"))


@query("name_mentions", f"WITH {BIGRAM_SQL} SELECT DISTINCT doc_id, 'D:' || term[1:3] AS disease_id FROM hits")
def name_mentions(t: Tables) -> DataFrame:
    """G8."""
    return R.name_mentions(t.documents, _word_index(t), "text", "doc_id")


@query(
    "first_alias",
    """
WITH a(alias, id, ord) AS (VALUES ('thandtion', 'A1', 0), ('eauouque', 'A2', 1), ('ererth', 'A3', 2), ('ouai', 'A4', 3), ('schber', 'A5', 4), ('th', 'A6', 5))
SELECT doc_id, (SELECT arg_min(id, ord) FROM a WHERE contains(lower(text), alias)) AS disease_id FROM documents""",
)
def first_alias(t: Tables) -> DataFrame:
    """G9."""
    aliases = literal_table(t.spark, 
        [("thandtion", "A1", 0), ("eauouque", "A2", 1), ("ererth", "A3", 2), ("ouai", "A4", 3), ("schber", "A5", 4), ("th", "A6", 5)],
        "alias string, disease_id string, ord int",
    )
    return R.match_alias(t.documents.select("doc_id", "text"), aliases).select("doc_id", "disease_id")


_BENCH_TERMS_SQL = "terms AS (SELECT w AS alias, row_number() OVER (ORDER BY length(w) DESC, w) - 1 AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark))"


def _bench_terms(t: Tables) -> DataFrame:
    """Every word of four or more letters of the benchmark, longest first."""
    words = t.benchmark.select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{4,}', 0)")).alias("alias")).distinct()
    return words.select("alias", F.concat(F.lit("W:"), "alias").alias("disease_id"), F.struct(-F.length("alias"), "alias").alias("ord"))


@query(
    "alias_table",
    f"""WITH {_BENCH_TERMS_SQL} SELECT doc_id, (SELECT 'W:' || arg_min(alias, ord) FROM terms WHERE contains(lower(text), alias)) AS disease_id FROM documents""",
)
def alias_table(t: Tables) -> DataFrame:
    """G9 with a large alias table."""
    return R.match_alias(t.documents.select("doc_id", "text"), _bench_terms(t)).select("doc_id", "disease_id")


@query(
    "name_contained",
    f"""WITH {_BENCH_TERMS_SQL} SELECT DISTINCT doc_id, 'W:' || alias AS disease_id FROM documents JOIN terms ON contains(lower(text), alias)""",
)
def name_contained(t: Tables) -> DataFrame:
    """G8 with containment anywhere."""
    terms = _bench_terms(t).select(F.col("alias").alias("term"), "disease_id")
    return R.name_mentions(t.documents, terms, "text", "doc_id", compat=True)
