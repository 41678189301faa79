"""Queries over notes derived from the driver tables: attributes, dates, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions.dates import parse_date
from chartweave.operators import attributes, checks
from chartweave.plans.derived import VISITS_SQL, charts, visits
from chartweave.plans.registry import Tables, query
from chartweave.scale import literal_table, pin


@query(
    "patient_info",
    f"WITH {VISITS_SQL} SELECT note_id, sex, CAST(age AS INTEGER) AS age, 'years' AS age_unit FROM visits",
)
def patient_info(t: Tables) -> DataFrame:
    """P8, English."""
    v = visits(t).select("note_id", attributes.patient_info(F.col("text"), F.lit("en")).alias("p"))
    return v.select("note_id", "p.*")


@query(
    "patient_info_fr",
    """
SELECT c_custkey, 'none' AS sex_seen, CAST(c_custkey % 17 + 1 AS INTEGER) AS age,
  CASE WHEN c_custkey % 3 = 0 THEN 'months' ELSE 'years' END AS age_unit FROM customer""",
)
def patient_info_fr(t: Tables) -> DataFrame:
    """P8, French; months stay months."""
    v = charts(t).select("c_custkey", attributes.patient_info(F.col("text"), F.lit("fr")).alias("p"))
    return v.select("c_custkey", F.coalesce("p.sex", F.lit("none")).alias("sex_seen"), "p.age", "p.age_unit")


_LETTERS = "translate(lpad(CAST({0} AS VARCHAR), 6, '0'), '0123456789', 'abcdefghij')"
_CAP = "upper({0}[1]) || {0}[2:]"
_CUST = f"""
c AS (SELECT c_custkey, {_LETTERS.format('c_custkey')} AS l, {_LETTERS.format('c_nationkey')} AS nl, lower(c_mktsegment) AS seg,
  CAST(c_custkey % 17 + 1 AS INTEGER) AS n FROM customer)
"""


@query(
    "dossier_attributes",
    f"""
WITH {_CUST} SELECT c_custkey, {_CAP.format('l')} || ' Zed' AS full_name, n || CASE WHEN c_custkey % 3 = 0 THEN ' mois' ELSE ' ans' END AS age,
  CASE WHEN c_custkey % 2 = 1 THEN 'F' ELSE 'M' END AS gender, 'Ville ' || {_CAP.format('nl')} AS origin, 'Ville ' || {_CAP.format('nl')} AS residence,
  (n + 25) || ' ans, sain' AS parent_father, '2eme degré' AS consanguinity, seg AS principal_diagnosis,
  CASE WHEN c_custkey % 4 <> 0 THEN 'asthme' END AS associated_diagnoses,
  CASE WHEN n <= 31 THEN strftime(make_date(2019, 3, n), '%Y-%m-%d') END AS date_of_diagnosis,
  lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS dossier_number,
  CASE WHEN c_custkey % 5 = 0 THEN 'Martin' END AS treating_doctor FROM c""",
)
def dossier_attributes(t: Tables) -> DataFrame:
    """P9."""
    d = charts(t).select("c_custkey", attributes.dossier_attributes(F.col("text")).alias("d"))
    keep = ["full_name", "age", "gender", "origin", "residence", "parent_father", "consanguinity", "principal_diagnosis",
            "associated_diagnoses", "dossier_number", "treating_doctor"]
    return d.select("c_custkey", *[f"d.{c}" for c in keep], F.col("d.date_of_diagnosis").cast("string").alias("date_of_diagnosis"))


@query(
    "filename_attributes",
    f"""
WITH {_CUST} SELECT c_custkey, {_CAP.format('l')} || ' Zed' AS patient_name, 'Durand' AS doctor_name,
  strftime(make_date(2021, 5, n), '%Y-%m-%d') AS report_date, CASE WHEN c_custkey % 2 = 0 THEN 'SCID' END AS pathology FROM c""",
)
def filename_attributes(t: Tables) -> DataFrame:
    """S6."""
    f = charts(t).select("c_custkey", attributes.filename_attributes(F.col("filename")).alias("f"))
    return f.select(
        "c_custkey", "f.patient_name", "f.doctor_name", F.col("f.report_date").cast("string").alias("report_date"), "f.pathology"
    )


@query(
    "attribute_precedence",
    f"""
WITH {_CUST} SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Form Name' ELSE {_CAP.format('l')} || ' Zed' END AS full_name,
  CASE WHEN c_custkey % 5 = 0 THEN 'Martin' ELSE 'Durand' END AS treating_doctor,
  CASE WHEN c_custkey % 7 = 0 THEN 'M' WHEN c_custkey % 2 = 1 THEN 'F' ELSE 'M' END AS gender, seg AS principal_diagnosis FROM c""",
)
def attribute_precedence(t: Tables) -> DataFrame:
    """P10: form, then content, then file name."""
    rows = charts(t).withColumn("content", attributes.dossier_attributes(F.col("text"))).withColumn(
        "from_name", attributes.filename_attributes(F.col("filename"))
    ).withColumn(
        "form", F.when(F.col("c_custkey") % 7 == 0, F.create_map(F.lit("full_name"), F.lit(" Form Name "), F.lit("gender"), F.lit("M"))).otherwise(F.create_map(F.lit("gender"), F.lit("")))
    )
    out = attributes.resolve_attributes(rows.select("c_custkey", "content", "from_name", "form"), "form")
    return out.select("c_custkey", "full_name", "treating_doctor", "gender", "principal_diagnosis")


@query(
    "date_formats",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS parsed FROM orders",
)
def date_formats(t: Tables) -> DataFrame:
    """V8: every order date is written in one of seven ways and read back."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    formats = ["dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "dd/MM/yy", "yyyy-M-d", "MMMM d, yyyy", "yyyy/MM/dd"]
    text = F.lit(None).cast("string")
    for i, f in enumerate(formats):
        text = F.when(key == i, F.date_format(day, f)).otherwise(text)
    return t.orders.select("o_orderkey", parse_date(text).cast("string").alias("parsed"))


@query(
    "key_dates",
    f"""
WITH {VISITS_SQL} SELECT note_id, strftime(dob, '%Y-%m-%d') AS dob, strftime(day, '%Y-%m-%d') AS note_date,
  strftime(event, '%Y-%m-%d') AS event_date, strftime(event, '%B %Y') AS raw FROM visits""",
)
def key_dates(t: Tables) -> DataFrame:
    """V9."""
    d = visits(t).select("note_id", pin(checks.key_dates(F.col("text"))).alias("d"))
    e = d.select("note_id", "d.dob", "d.note_date", F.explode("d.events").alias("e"))
    return e.select(
        "note_id", F.col("dob").cast("string").alias("dob"), F.col("note_date").cast("string").alias("note_date"),
        F.col("e.date").cast("string").alias("event_date"), "e.raw",
    )


_TEMPORAL_SQL = f"""
WITH {VISITS_SQL}, w AS (
  SELECT note_id, 'event_before_birth' AS type, 'critical' AS severity, strftime(event, '%Y-%m-%d') AS a, strftime(dob, '%Y-%m-%d') AS b FROM visits WHERE event < dob
  UNION ALL SELECT note_id, 'age_dob_mismatch', 'warning', CAST(age AS VARCHAR), CAST((day - dob) // 365 AS VARCHAR) FROM visits WHERE abs(age - (day - dob) // 365) > 1)
"""


@query("temporal_warnings", _TEMPORAL_SQL + "SELECT note_id, type, severity, a AS first_value, b AS second_value FROM w")
def temporal_warnings(t: Tables) -> DataFrame:
    """V10 + V11."""
    v = visits(t).select("note_id", pin(checks.key_dates(F.col("text"))).alias("d"), pin(checks.stated_age(F.col("text"))).alias("age_said"))
    w = v.select("note_id", pin(checks.temporal_warnings(F.col("d"), F.col("age_said"))).alias("w")).select("note_id", F.explode("w").alias("w"))
    attr = lambda k: F.element_at("w.attrs", F.lit(k))
    return w.select(
        "note_id", "w.type", "w.severity", F.coalesce(attr("event_date"), attr("stated_age")).alias("first_value"),
        F.coalesce(attr("dob"), attr("calculated_age")).alias("second_value"),
    )


@query(
    "ship_date_checks",
    """
SELECT l_orderkey, l_linenumber, l_shipdate < o_orderdate AS before_order,
  CAST(floor(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS weeks
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def ship_date_checks(t: Tables) -> DataFrame:
    """V10 + V11 predicates between two large tables: one co-partitioned join."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey"
    )
    return rows.select(
        "l_orderkey", "l_linenumber", checks.before_birth(F.col("l_shipdate"), F.col("o_orderdate")).alias("before_order"),
        F.floor(F.datediff("l_shipdate", "o_orderdate") / 7).cast("int").alias("weeks"),
    )


@query(
    "numeric_findings",
    f"""
WITH {VISITS_SQL}, f AS (
  SELECT note_id, 'HP:0001945' AS concept_id, CAST(temp AS DOUBLE) AS value FROM visits WHERE temp >= 38.0
  UNION ALL SELECT note_id, 'HP:0001943', CAST(glucose AS DOUBLE) FROM visits WHERE glucose < 70
  UNION ALL SELECT note_id, 'HP:0003074', CAST(CASE WHEN glucose > 200 THEN glucose ELSE a1c END AS DOUBLE) FROM visits WHERE glucose > 200 OR a1c > 6.5
  UNION ALL SELECT note_id, 'HP:0001974', CAST(wbc AS DOUBLE) FROM visits WHERE wbc > 11
  UNION ALL SELECT note_id, 'HP:0001873', CAST(plt AS DOUBLE) FROM visits WHERE plt < 150)
SELECT note_id, concept_id, value FROM f""",
)
def numeric_findings(t: Tables) -> DataFrame:
    """V12 with the standard rules over notes."""
    return checks.numeric_findings(visits(t)).select("note_id", "concept_id", "value")


@query(
    "numeric_rules",
    """
SELECT event_id, concept_id, value FROM (
  SELECT event_id, 'C:high' AS concept_id, CAST(k AS DOUBLE) AS value FROM (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events) WHERE CASE WHEN k > 50 THEN k > 80 ELSE k > 40 END
  UNION ALL SELECT event_id, 'C:low', CAST(k AS DOUBLE) FROM (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events) WHERE k < 10)""",
)
def numeric_rules(t: Tables) -> DataFrame:
    """V12 with a rule table, one rule switching its scale."""
    rules = literal_table(t.spark, 
        [
            (1, '"k": ([0-9]+)', "", ">", 40.0, 50.0, 80.0, "C:high", "high", ""),
            (2, '"k": ([0-9]+)', "", "<", 10.0, None, None, "C:low", "low", ""),
            (3, '"k": ([0-9]+)', "", "<", 5.0, None, None, "C:low", "very low", ""),
        ],
        "rule_id int, pattern string, unit string, op string, threshold double, switch_at double, alt_threshold double, "
        "concept_id string, name string, description string",
    )
    found = checks.numeric_findings(t.events, "props", checks.numeric_rules_from_table(rules), "event_id")
    return found.select("event_id", "concept_id", "value")


@query(
    "sex_conflicts",
    f"""
WITH {VISITS_SQL} SELECT note_id, CASE WHEN sex = 'male' THEN 'ovarian' ELSE 'prostate' END AS term FROM visits
WHERE (sex = 'male' AND o_orderkey % 3 = 0) OR (sex = 'female' AND o_orderkey % 3 = 1)""",
)
def sex_conflicts(t: Tables) -> DataFrame:
    """V13."""
    v = visits(t).withColumn("p", attributes.patient_info(F.col("text"), F.lit("en")))
    return v.select("note_id", F.explode(checks.opposite_sex_terms(F.lower("text"), F.col("p.sex"))).alias("term"))


@query("lab_contradictions", f"WITH {VISITS_SQL} SELECT note_id FROM visits WHERE glucose < 70 AND a1c >= 8")
def lab_contradictions(t: Tables) -> DataFrame:
    """V14."""
    return visits(t).where(checks.lab_contradiction(F.lower("text"))).select("note_id")


@query(
    "drug_conflicts",
    f"""
WITH {VISITS_SQL}, d AS (SELECT note_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'warfarin' WHEN '2-HIGH' THEN 'metformin' WHEN '3-MEDIUM' THEN 'ibuprofen' WHEN '4-NOT SPECIFIED' THEN 'aspirin' END AS drug,
  CASE o_orderstatus WHEN 'F' THEN 'hemophilia' WHEN 'O' THEN 'renal failure' WHEN 'P' THEN 'peptic ulcer' END AS cond FROM visits)
SELECT note_id, severity FROM (
  SELECT note_id, 'critical' AS severity FROM d WHERE drug IN ('warfarin', 'aspirin') AND cond = 'hemophilia'
  UNION ALL SELECT note_id, 'warning' FROM d WHERE drug = 'metformin' AND cond = 'renal failure'
  UNION ALL SELECT note_id, 'warning' FROM d WHERE drug IN ('ibuprofen', 'aspirin') AND cond = 'peptic ulcer')""",
)
def drug_conflicts(t: Tables) -> DataFrame:
    """V15 with the standard rules; other warnings are left out."""
    w = visits(t).select(
        "note_id",
        F.explode(checks.inconsistency_warnings(F.col("text"), F.array().cast("array<string>"), F.lit(None).cast("string"))).alias("w"),
    )
    return w.where("w.type = 'drug_disease_conflict'").select("note_id", "w.severity")


@query(
    "conflict_pairs",
    """
SELECT doc_id, r AS rule_id FROM documents, (VALUES (0), (1)) v(r)
WHERE CASE r WHEN 0 THEN (contains(lower(text), 'eaueau') OR contains(lower(text), 'thth')) AND (contains(lower(text), 'tionre') OR contains(lower(text), 'ernd'))
  ELSE contains(lower(text), 'ouou') AND (contains(lower(text), 'xment') OR contains(lower(text), 'elleé')) END""",
)
def conflict_pairs(t: Tables) -> DataFrame:
    """V15 with a rule table over all documents."""
    rules = literal_table(t.spark, 
        [(0, "drug", "eaueau", "x", "m"), (0, "drug", "thth", "x", "m"), (0, "condition", "tionre", "x", "m"),
         (0, "condition", "ernd", "x", "m"), (1, "drug", "ouou", "x", "m"), (1, "condition", "xment", "x", "m"),
         (1, "condition", "elleé", "x", "m")],
        "rule_id int, side string, term string, severity string, message string",
    )
    flags = checks.term_conflicts(F.lower("text"), checks.conflict_rules_from_table(rules))
    return t.documents.select("doc_id", F.posexplode(flags).alias("rule_id", "hit")).where("hit").select("doc_id", "rule_id")
