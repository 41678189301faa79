"""Queries over evaluation metrics and patient documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import document as D
from chartweave.operators import metrics as M
from chartweave.operators import normalize as N
from chartweave.operators import ontology as G
from chartweave.operators import reports as R
from chartweave.plans.registry import Tables, query

from chartweave.plans.graph_queries import RANK_SQL, ranked_orders

# Orders are notes. Extracted concepts are the sizes of their parts, expected ones
# are derived from the customer; sizes form a binary tree under "s0".


def _extracted(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("s"), "p_size").alias("hpo_id"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("note_id"), "l_partkey", F.col("l_linenumber").alias("seq"),
        (F.col("l_returnflag") == "R").alias("negated"), F.col("l_discount").alias("confidence"),
    ).join(part, "l_partkey")


def _expected(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    ids = F.array_distinct(F.array(*[F.concat(F.lit("s"), ((k * m) % 50 + 1).cast("string")) for m in (3, 7, 11)]))
    return t.orders.select(F.col("o_orderkey").alias("note_id"), F.explode(ids).alias("concept_id"))


def _size_edges(t: Tables) -> DataFrame:
    return t.part.select("p_size").distinct().select(
        F.concat(F.lit("s"), "p_size").alias("child"), F.concat(F.lit("s"), F.floor(F.col("p_size") / 2)).alias("parent")
    )


def _groups(t: Tables) -> DataFrame:
    """Sizes with the same remainder by 17 are interchangeable."""
    return t.part.select("p_size").distinct().select(
        (F.col("p_size") % 17).alias("group_id"), F.concat(F.lit("s"), "p_size").alias("concept_id")
    )


_EX_SQL = """
ex AS (SELECT DISTINCT l_orderkey AS note_id, 's' || p_size AS c FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
eq AS (SELECT DISTINCT a.p_size AS a, b.p_size AS b FROM part a JOIN part b ON a.p_size % 17 = b.p_size % 17),
xp AS (SELECT DISTINCT o_orderkey AS note_id, 's' || ((o_custkey * m) % 50 + 1) AS c FROM orders, (VALUES (3), (7), (11)) v(m))
"""


@query(
    "extracted_concepts",
    f"WITH {_EX_SQL} SELECT note_id, count(*) AS n, min(c) AS first_id FROM ex GROUP BY note_id",
)
def extracted_concepts(t: Tables) -> DataFrame:
    """M1."""
    return M.extracted_concepts(_extracted(t)).groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.min("concept_id").alias("first_id"))


@query("equivalents", f"WITH {_EX_SQL} SELECT 's' || a AS concept_id, 's' || b AS equivalent FROM eq")
def equivalents(t: Tables) -> DataFrame:
    """M2."""
    return M.equivalents(_groups(t))


def _matches(t: Tables) -> DataFrame:
    near = G.bounded_ancestors(_size_edges(t), 2, "s0")
    return M.semantic_matches(M.extracted_concepts(_extracted(t)), _expected(t), M.equivalents(_groups(t)), near)


#: Pass 2 in SQL: a note expects at most three ids, so its greedy choice is three steps in id order.
_PRF_SQL = f"""
WITH {_EX_SQL}, u1 AS (SELECT xp.note_id, xp.c, min(ex.c) AS e FROM xp JOIN eq ON xp.c = 's' || eq.a JOIN ex ON ex.note_id = xp.note_id AND ex.c = 's' || eq.b GROUP BY ALL),
up1 AS (SELECT DISTINCT 's' || p_size AS t, 's' || (p_size // 2) AS a FROM part WHERE p_size // 2 > 0),
up AS (SELECT t, a FROM up1 UNION SELECT x.t, y.a FROM up1 x JOIN up1 y ON x.a = y.t),
rel AS (SELECT t AS xc, a AS ec FROM up WHERE t <> a UNION SELECT a, t FROM up WHERE t <> a),
lx AS (SELECT note_id, c, row_number() OVER (PARTITION BY note_id ORDER BY c) AS r FROM xp ANTI JOIN u1 ON xp.note_id = u1.note_id AND xp.c = u1.c),
le AS (SELECT ex.note_id, ex.c FROM ex ANTI JOIN u1 ON ex.note_id = u1.note_id AND ex.c = u1.e),
cand AS (SELECT lx.note_id, lx.r, le.c AS e FROM lx JOIN rel ON lx.c = rel.xc JOIN le ON le.note_id = lx.note_id AND le.c = rel.ec),
g1 AS (SELECT note_id, min(e) AS e FROM cand WHERE r = 1 GROUP BY note_id),
g2 AS (SELECT c.note_id, min(c.e) AS e FROM cand c LEFT JOIN g1 USING (note_id) WHERE r = 2 AND c.e IS DISTINCT FROM g1.e GROUP BY c.note_id),
g3 AS (SELECT c.note_id, min(c.e) AS e FROM cand c LEFT JOIN g1 USING (note_id) LEFT JOIN g2 USING (note_id) WHERE r = 3 AND c.e IS DISTINCT FROM g1.e AND c.e IS DISTINCT FROM g2.e GROUP BY c.note_id),
p2 AS (SELECT note_id, count(*) AS n2 FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3) GROUP BY note_id),
m AS (SELECT o.note_id, coalesce(n_ext, 0) AS n_ext, n_exp, coalesce(tp, 0) + coalesce(n2, 0) AS tp, coalesce(used, 0) + coalesce(n2, 0) AS used
  FROM (SELECT note_id, count(*) AS n_exp FROM xp GROUP BY ALL) o LEFT JOIN (SELECT note_id, count(*) AS n_ext FROM ex GROUP BY ALL) USING (note_id)
  LEFT JOIN (SELECT note_id, count(*) AS tp, count(DISTINCT e) AS used FROM u1 GROUP BY ALL) USING (note_id) LEFT JOIN p2 USING (note_id)),
r AS (SELECT *, CAST(tp AS DOUBLE) / greatest(n_exp, 1) AS rec, CASE WHEN n_ext > 0 THEN CAST(tp AS DOUBLE) / greatest(n_ext, 1) ELSE 0.0 END AS prec FROM m)
"""


@query("semantic_matches", _PRF_SQL + "SELECT note_id, tp, n_exp - tp AS fn, n_ext - used AS fp, n_ext AS n_extracted, n_exp AS n_expected FROM r")
def semantic_matches(t: Tables) -> DataFrame:
    """M3, both passes."""
    return _matches(t).select("note_id", "tp", "fn", "fp", "n_extracted", "n_expected")


def _prf(t: Tables) -> DataFrame:
    return M.note_prf(_matches(t))


@query(
    "note_prf",
    _PRF_SQL + """SELECT note_id, tp, n_exp - tp AS fn, n_ext - used AS fp, CAST(round(prec, 6) AS DOUBLE) AS "precision", CAST(round(rec, 6) AS DOUBLE) AS recall,
  CAST(round(2 * prec * rec / greatest(prec + rec, 1e-9), 6) AS DOUBLE) AS f1 FROM r""",
)
def note_prf(t: Tables) -> DataFrame:
    """M3 + M4."""
    return _prf(t).select(
        "note_id", "tp", "fn", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")
    )


@query(
    "corpus_prf",
    _PRF_SQL + """, s AS (SELECT sum(tp) AS tp, sum(n_exp - tp) AS fn, sum(n_ext) AS ne, avg(prec) AS mp, avg(rec) AS mr, count(*) AS n FROM r),
  q AS (SELECT *, CAST(tp AS DOUBLE) / greatest(ne, 1) AS p, CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS rc FROM s)
  SELECT CAST(round(p, 4) AS DOUBLE) AS micro_precision, CAST(round(rc, 4) AS DOUBLE) AS micro_recall, CAST(round(2 * p * rc / greatest(p + rc, 1e-9), 4) AS DOUBLE) AS micro_f1,
    CAST(round(mp, 4) AS DOUBLE) AS macro_precision, CAST(round(mr, 4) AS DOUBLE) AS macro_recall, CAST(round(2 * mp * mr / greatest(mp + mr, 1e-9), 4) AS DOUBLE) AS macro_f1,
    CAST(tp AS BIGINT) AS total_tp, CAST(fn AS BIGINT) AS total_fn, CAST(ne AS BIGINT) AS total_extracted, n AS notes FROM q""",
)
def corpus_prf(t: Tables) -> DataFrame:
    """M5."""
    return M.corpus_prf(_prf(t))


@query(
    "disease_prf",
    _PRF_SQL + """SELECT o_orderpriority AS disease, count(*) AS reports, CAST(sum(n_exp) AS BIGINT) AS gold_size, CAST(round(avg(prec), 4) AS DOUBLE) AS "precision",
  CAST(round(avg(rec), 4) AS DOUBLE) AS recall, CAST(round(avg(2 * prec * rec / greatest(prec + rec, 1e-9)), 4) AS DOUBLE) AS f1 FROM r JOIN orders ON note_id = o_orderkey GROUP BY ALL""",
)
def disease_prf(t: Tables) -> DataFrame:
    """M13."""
    rows = _prf(t).join(t.orders.select(F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("disease")), "note_id")
    return M.disease_prf(rows)


@query(
    "cascade_distribution",
    """
WITH e AS (SELECT l_linestatus AS lang, CASE WHEN l_returnflag = 'N' THEN 'no_match' ELSE l_returnflag || (l_linenumber % 3) END AS match_type, l_returnflag <> 'N' AS matched, l_discount AS c FROM lineitem),
g AS (SELECT lang, match_type, count(*) AS n, count(*) FILTER (matched) AS m, avg(c) FILTER (matched) AS conf FROM e GROUP BY ALL)
SELECT lang, match_type, n AS count, CAST(round(CAST(n AS DOUBLE) / sum(n) OVER w * 100, 1) AS DOUBLE) AS pct, CAST(round(coalesce(conf, 0.0), 3) AS DOUBLE) AS avg_conf,
  CAST(sum(n) OVER w AS BIGINT) AS total, CAST(sum(m) OVER w AS BIGINT) AS matched, CAST(round(CAST(sum(m) OVER w AS DOUBLE) / sum(n) OVER w, 3) AS DOUBLE) AS coverage FROM g WINDOW w AS (PARTITION BY lang)""",
)
def cascade_distribution(t: Tables) -> DataFrame:
    """M6 per line status."""
    e = t.lineitem.select(
        F.col("l_linestatus").alias("lang"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("match_type"),
        (F.col("l_returnflag") != "N").alias("matched"), F.col("l_discount").alias("confidence"),
    )
    return M.cascade_distribution(e, ["lang"])


@query(
    "topk_accuracy",
    RANK_SQL + """, gold AS (SELECT o_orderkey AS note_id, CAST(c_nationkey AS VARCHAR) AS disease_id FROM orders JOIN customer ON o_custkey = c_custkey),
  g AS (SELECT gold.note_id, min(rank) AS r FROM gold LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) rk ON rk.note_id = gold.note_id AND rk.disease_id = gold.disease_id GROUP BY ALL)
  SELECT count(*) AS total, count(*) FILTER (r <= 1) AS top1, CAST(round(CAST(count(*) FILTER (r <= 1) AS DOUBLE) / count(*), 3) AS DOUBLE) AS top1_acc,
    count(*) FILTER (r <= 3) AS top3, CAST(round(CAST(count(*) FILTER (r <= 3) AS DOUBLE) / count(*), 3) AS DOUBLE) AS top3_acc,
    count(*) FILTER (r <= 5) AS top5, CAST(round(CAST(count(*) FILTER (r <= 5) AS DOUBLE) / count(*), 3) AS DOUBLE) AS top5_acc,
    count(*) FILTER (r <= 10) AS top10, CAST(round(CAST(count(*) FILTER (r <= 10) AS DOUBLE) / count(*), 3) AS DOUBLE) AS top10_acc FROM g""",
)
def topk_accuracy(t: Tables) -> DataFrame:
    """M7: the customer's nation as gold for the ranking of each order."""
    gold = t.orders.select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("c_custkey")).join(
        t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("disease_id")), "c_custkey"
    )
    return M.topk_accuracy(ranked_orders(t), gold)


@query(
    "top_cues",
    """SELECT p_name AS negation_cue, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_cues(t: Tables) -> DataFrame:
    """M8."""
    e = t.lineitem.select("l_partkey", (F.col("l_returnflag") == "R").alias("negated")).join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("negation_cue")), "l_partkey"
    )
    return M.top_cues(e)


@query(
    "detection_stats",
    """
WITH e AS (SELECT l_orderkey AS note_id, count(*) FILTER (l_returnflag = 'R') AS neg, count(*) FILTER (l_discount > 0.08) AS t, count(*) FILTER (l_tax > 0.07) AS i FROM lineitem GROUP BY ALL)
SELECT o_orderpriority AS lang, CAST(sum(coalesce(t, 0)) AS BIGINT) AS temporal, CAST(sum(coalesce(i, 0)) AS BIGINT) AS inconsistencies, count(*) AS reports, CAST(sum(coalesce(neg, 0)) AS BIGINT) AS negated
FROM orders LEFT JOIN e ON note_id = o_orderkey GROUP BY ALL""",
)
def detection_stats(t: Tables) -> DataFrame:
    """M8 per order priority."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("note_id"), "l_returnflag", "l_discount", "l_tax")
    per = lines.groupBy("note_id").agg(F.count_if(F.col("l_discount") > 0.08).alias("a"), F.count_if(F.col("l_tax") > 0.07).alias("b"))
    orders = t.orders.select(F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("lang"))
    many = lambda c: F.array_repeat(F.lit(1), F.coalesce(F.col(c), F.lit(0)).cast("int"))
    notes = orders.join(per, "note_id", "left").select("lang", many("a").alias("temporal"), many("b").alias("inconsistencies"))
    ents = lines.join(orders, "note_id").select("lang", (F.col("l_returnflag") == "R").alias("negated"))
    return M.detection_stats(notes, ents, ["lang"])


@query(
    "group_comparison",
    """
WITH m AS (SELECT CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS lang, avg(n_chars) AS chars, avg(quality) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('fr', 'en') GROUP BY ALL),
l AS (SELECT lang, 'chars' AS metric, CAST(chars AS DOUBLE) AS v FROM m UNION ALL SELECT lang, 'quality', CAST(quality AS DOUBLE) FROM m UNION ALL SELECT lang, 'n', CAST(n AS DOUBLE) FROM m)
SELECT metric, CAST(round(max(v) FILTER (lang = 'fr'), 6) AS DOUBLE) AS fr, CAST(round(max(v) FILTER (lang = 'en'), 6) AS DOUBLE) AS en,
  CAST(round(max(v) FILTER (lang = 'fr') - max(v) FILTER (lang = 'en'), 6) AS DOUBLE) AS delta FROM l GROUP BY metric""",
)
def group_comparison(t: Tables) -> DataFrame:
    """M10."""
    m = t.documents.where(F.col("lang").isin("fr", "en")).select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    wide = m.groupBy("lang").agg(
        F.avg("n_chars").alias("chars"), F.avg("quality").alias("quality"), F.count(F.lit(1)).cast("double").alias("n")
    )
    long = wide.unpivot(["lang"], ["chars", "quality", "n"], "metric", "value")
    out = M.compare_groups(long)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("fr", "en", "delta")])


# ------------------------------------------------------------------ documents
def _doc_inputs(t: Tables) -> tuple[DataFrame, ...]:
    """Orders as notes, their lines as entities, big orders as numeric findings."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    size_cat = F.when(F.col("p_size") <= 20, "problem").when(F.col("p_size") <= 35, "treatment").otherwise("test")
    ents = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_discount", "l_returnflag").join(part, "l_partkey").select(
        F.col("l_orderkey").alias("note_id"), size_cat.alias("category"),
        (F.col("l_linenumber").cast("long") * 100000 + F.col("l_suppkey")).alias("seq"), F.col("p_name").alias("text"),
        F.lit(0.5).alias("score"), (F.col("l_returnflag") == "R").alias("negated"), F.lit("no").alias("negation_cue"),
        F.when(F.col("l_returnflag") != "N", F.concat_ws("/", "p_type", "p_size")).alias("hpo_id"), F.col("p_name").alias("hpo_name"),
        F.lit("exact_label").alias("match_type"), F.col("l_discount").alias("confidence"), (F.col("l_returnflag") != "N").alias("matched"),
        F.lit(None).cast("string").alias("umls_cui"), F.col("p_name").alias("expanded_text"),
    )
    notes = t.orders.select(
        F.col("o_orderkey").alias("note_id"), F.lit("en").alias("language"), F.col("o_orderpriority").alias("clean_text"),
        F.struct(
            F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male").alias("sex"),
            (F.col("o_custkey") % 90).cast("int").alias("age"), F.when(F.col("o_custkey") % 2 == 0, "months").otherwise("years").alias("age_unit"),
        ).alias("patient_info"),
        F.array_repeat(F.lit("w"), (F.col("o_orderkey") % 3).cast("int")).alias("temporal"),
        F.array_repeat(F.lit("w"), (F.col("o_orderkey") % 2).cast("int")).alias("inconsistencies"),
    )
    numeric = t.orders.where(F.col("o_totalprice") > 300000).select(
        F.col("o_orderkey").alias("note_id"), F.lit(0).alias("seq"), F.lit("BIG").alias("concept_id"), F.lit("Big order").alias("name"),
        F.lit("total").alias("source"), F.lit("above limit").alias("description"),
    )
    cands = t.orders.where(F.col("o_custkey") % 4 != 0).select(
        F.col("o_orderkey").alias("note_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "o_custkey", "o_orderpriority"
    ).select("note_id", "rank", F.concat(F.lit("D"), (F.col("o_custkey") + F.col("rank")).cast("string")).alias("disease_id"),
             F.concat_ws(" ", "o_orderpriority", "rank").alias("name"), (1.0 / F.col("rank")).alias("score"))
    return notes, ents, numeric, cands, N.match_stats(ents, cands)


def order_documents(t: Tables) -> DataFrame:
    notes, ents, numeric, cands, stats = _doc_inputs(t)
    return D.documents(notes, ents, numeric, cands, stats, created=F.to_timestamp(F.lit("2024-01-01 00:00:00")))


_DOC_SQL = """
le AS (SELECT l_orderkey AS note_id, CASE WHEN p_size <= 20 THEN 0 WHEN p_size <= 35 THEN 1 ELSE 2 END AS c, l_linenumber * 100000 + l_suppkey AS s,
   CASE WHEN l_returnflag <> 'N' THEN p_type || '/' || p_size END AS id, l_returnflag = 'R' AS neg, l_returnflag <> 'N' AS matched, l_discount AS conf, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
f1 AS (SELECT note_id, id, c, s, neg, p_name FROM (SELECT *, row_number() OVER (PARTITION BY note_id, id ORDER BY c, s) AS rn FROM le WHERE matched) WHERE rn = 1
   UNION ALL SELECT o_orderkey, 'BIG', 4, 0, false, 'Big order' FROM orders WHERE o_totalprice > 300000),
f AS (SELECT note_id, count(*) AS nf, count(*) FILTER (neg) AS nneg, string_agg(id, ',' ORDER BY c, s, id) AS ids FROM f1 GROUP BY note_id),
st AS (SELECT note_id, count(*) AS total, count(*) FILTER (matched) AS nm, avg(conf) FILTER (conf > 0) AS conf FROM le GROUP BY note_id)
"""


@query(
    "patient_documents",
    f"""WITH {_DOC_SQL} SELECT o_orderkey AS note_id, 'phenopacket-' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'FEMALE' WHEN 'O' THEN 'MALE' END AS sex,
  'P' || (o_custkey % 90) || CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'Y' END AS age, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority || ' 1' END AS target,
  coalesce(nf, 0) AS n_features, coalesce(nneg, 0) AS negated, coalesce(ids, '') AS feature_ids, CASE WHEN o_custkey % 4 <> 0 THEN 2 ELSE 0 END AS n_candidates,
  o_orderkey % 3 + o_orderkey % 2 AS n_warnings, coalesce(total, 0) AS total_entities, coalesce(nm, 0) AS matched FROM orders LEFT JOIN f ON f.note_id = o_orderkey LEFT JOIN st ON st.note_id = o_orderkey""",
)
def patient_documents(t: Tables) -> DataFrame:
    """O1 - O4, flattened for comparison."""
    p = "phenopacket"
    return order_documents(t).select(
        "note_id", f"{p}.id", f"{p}.subject.sex", f"{p}.subject.timeAtLastEncounter.age.iso8601duration",
        f"{p}.target", F.size(f"{p}.phenotypicFeatures").alias("n_features"), f"{p}._pipelineStats.negatedFeatures",
        F.array_join(F.transform(f"{p}.phenotypicFeatures", lambda f: f["type"]["id"]), ",").alias("feature_ids"),
        F.coalesce(F.size(F.get(f"{p}.interpretations", F.lit(0))["diagnosis"]["allCandidates"]), F.lit(0)).alias("n_cand"),
        F.coalesce(F.size(f"{p}._validationWarnings"), F.lit(0)).alias("n_warnings"), f"{p}._pipelineStats.totalEntities", f"{p}._pipelineStats.matchedHPO",
    ).withColumnsRenamed({"iso8601duration": "age", "negatedFeatures": "negated", "totalEntities": "total_entities", "matchedHPO": "matched", "n_cand": "n_candidates"}).withColumn(
        "n_candidates", F.greatest("n_candidates", F.lit(0))
    )


@query(
    "full_documents",
    f"""WITH {_DOC_SQL} SELECT o_orderkey AS note_id, count(*) FILTER (c = 0) AS n_problem, count(*) FILTER (c = 1) AS n_treatment, count(*) FILTER (c = 2) AS n_test,
  CAST(max(o_totalprice > 300000) AS BIGINT) AS n_numeric, CASE WHEN max(o_custkey) % 4 <> 0 THEN 2 ELSE 0 END AS n_candidates FROM orders LEFT JOIN le ON le.note_id = o_orderkey GROUP BY o_orderkey""",
)
def full_documents(t: Tables) -> DataFrame:
    """O5, flattened for comparison."""
    notes, ents, numeric, cands, stats = _doc_inputs(t)
    packets = D.documents(notes, ents, numeric, cands, stats, created=F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    full = D.full_output(notes.withColumn("phi_map", F.create_map().cast("map<string,array<string>>")), ents, numeric, cands, stats, packets)
    n = lambda c: F.greatest(F.coalesce(F.size(f"module4.{c}"), F.lit(0)), F.lit(0)).cast("long")
    return full.select(
        "note_id", n("problem").alias("n_problem"), n("treatment").alias("n_treatment"), n("test").alias("n_test"),
        n("numeric_phenotypes").alias("n_numeric"), n("ordo_candidates").alias("n_candidates"),
    )


@query(
    "compliance",
    f"""WITH {_DOC_SQL} SELECT count(*) FILTER (nf > 0) AS compliant, count(*) AS total, CAST(round(CAST(sum(coalesce(nf, 0)) AS DOUBLE) / count(*), 1) AS DOUBLE) AS avg_features,
  count(*) FILTER (o_custkey % 4 <> 0) AS with_interpretations, count(*) FILTER (nneg > 0) AS with_excluded FROM orders LEFT JOIN f ON f.note_id = o_orderkey""",
)
def compliance(t: Tables) -> DataFrame:
    """M9."""
    return M.compliance(order_documents(t))


_SCORE_SQL = f"""
WITH {_DOC_SQL}, x AS (SELECT o_orderpriority AS corpus, (3 + 3 + CASE WHEN o_orderstatus IN ('F', 'O') THEN 2 ELSE 0 END + CASE WHEN coalesce(nf, 0) > 0 THEN 3 ELSE 0 END + CASE WHEN o_custkey % 4 <> 0 THEN 2 ELSE 0 END + 1) / CAST(14 AS DOUBLE) * 100 AS s,
   greatest(0, least(100, (1 - (o_orderkey % 3 + o_orderkey % 2) / CAST(greatest(coalesce(total, 0), 5) AS DOUBLE)) * 100)) AS c,
   coalesce(nm, 0) / CAST(greatest(coalesce(total, 0), 1) AS DOUBLE) * 100 AS o, least(100, coalesce(conf * 100, 50)) AS r,
   coalesce(total, 0) / CAST(greatest(coalesce(total, 0), 1) AS DOUBLE) * 100 AS e FROM orders LEFT JOIN f ON f.note_id = o_orderkey LEFT JOIN st ON st.note_id = o_orderkey),
g AS (SELECT corpus, count(*) AS n, avg(s) AS s, avg(c) AS c, avg(o) AS o, avg(r) AS r, avg(e) AS e, min(c) AS cmin, max(o) AS omax FROM x GROUP BY corpus)
SELECT corpus, n AS n_reports, CAST(round(s, 1) AS DOUBLE) AS S_mean, CAST(round(c, 1) AS DOUBLE) AS C_mean, CAST(round(o, 1) AS DOUBLE) AS O_mean, CAST(round(r, 1) AS DOUBLE) AS R_mean, CAST(round(e, 1) AS DOUBLE) AS E_mean,
  CAST(round(cmin, 1) AS DOUBLE) AS C_min, CAST(round(omax, 1) AS DOUBLE) AS O_max, CAST(round(0.20 * s + 0.25 * c + 0.20 * o + 0.20 * r + 0.15 * e, 1) AS DOUBLE) AS composite,
  CASE WHEN 0.20 * s + 0.25 * c + 0.20 * o + 0.20 * r + 0.15 * e >= 90 THEN 'Excellent' WHEN 0.20 * s + 0.25 * c + 0.20 * o + 0.20 * r + 0.15 * e >= 75 THEN 'Good'
    WHEN 0.20 * s + 0.25 * c + 0.20 * o + 0.20 * r + 0.15 * e >= 60 THEN 'Acceptable' WHEN 0.20 * s + 0.25 * c + 0.20 * o + 0.20 * r + 0.15 * e >= 40 THEN 'Fair' ELSE 'Poor' END AS rating FROM g
"""


@query("score_framework", _SCORE_SQL)
def score_framework(t: Tables) -> DataFrame:
    """M11 per order priority."""
    notes, ents, _, _, _ = _doc_inputs(t)
    rows = M.score_notes(order_documents(t), notes, ents).join(notes.select("note_id", F.col("clean_text").alias("corpus")), "note_id")
    s = M.score_summary(rows, ["corpus"])
    return s.select("corpus", "n_reports", "S_mean", "C_mean", "O_mean", "R_mean", "E_mean", "C_min", "O_max", "composite", "rating")


@query(
    "efficiency",
    "SELECT event_type AS corpus, CAST(round(avg(value), 2) AS DOUBLE) AS avg_time, count(*) AS reports FROM events GROUP BY ALL",
)
def efficiency(t: Tables) -> DataFrame:
    """M12."""
    return M.efficiency(t.events.select(F.col("event_type").alias("corpus"), F.col("value").alias("time")), by=["corpus"])


@query(
    "fill_rates",
    f"""WITH {_DOC_SQL}, x AS (SELECT o_orderpriority AS corpus, avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN coalesce(nf, 0) > 0 THEN 1.0 ELSE 0.0 END) AS b,
   avg(CASE WHEN o_custkey % 4 <> 0 THEN 1.0 ELSE 0.0 END) AS c FROM orders LEFT JOIN f ON f.note_id = o_orderkey GROUP BY ALL)
 SELECT corpus, 'subject_sex' AS field, CAST(round(a * 100, 1) AS DOUBLE) AS fill_pct FROM x UNION ALL SELECT corpus, 'phenotypicFeatures', CAST(round(b * 100, 1) AS DOUBLE) FROM x
 UNION ALL SELECT corpus, 'interpretations', CAST(round(c * 100, 1) AS DOUBLE) FROM x UNION ALL SELECT corpus, 'metaData', 100.0 FROM x""",
)
def fill_rates(t: Tables) -> DataFrame:
    """M14."""
    docs = order_documents(t).select(F.col("phenopacket.input").alias("corpus"), "phenopacket.*")
    rates = M.fill_rates(docs, ["subject.sex", "phenotypicFeatures", "interpretations", "metaData"], ["corpus"])
    return rates


@query(
    "run_summary",
    f"""WITH {_DOC_SQL} SELECT note_id, count(*) AS total_entities, count(*) FILTER (matched) AS matched_hpo, count(*) FILTER (neg) AS negated_count,
  count(*) FILTER (c = 0) AS n_problem, count(*) FILTER (c = 1) AS n_treatment, count(*) FILTER (c = 2) AS n_test,
  CAST(max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS numeric_phenotypes FROM le LEFT JOIN orders ON o_orderkey = note_id GROUP BY note_id""",
)
def run_summary(t: Tables) -> DataFrame:
    """R17."""
    _, ents, numeric, _, _ = _doc_inputs(t)
    return R.run_summary(ents, numeric)
