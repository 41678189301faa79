"""Queries over report and dossier tables, case selection, streams, whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import reports as R
from chartweave.operators.search_index import SearchIndex
from chartweave.plans.derived import charts
from chartweave.plans.registry import Tables, query
from chartweave.plans.text_queries import RULES, _phi_sql, bigrams
from chartweave.session import durable_folder
from chartweave.sources.articles import longest_per_group, number_cases


# Customers are dossiers and orders their reports.
def dossiers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    age = F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, F.concat((k % 40).cast("string"), F.lit(" mois"))).otherwise(
        F.concat((k % 19).cast("string"), F.lit(" ans"))
    )
    return t.customer.select(
        k.alias("id"), F.when(k % 4 != 0, F.lpad(k.cast("string"), 6, "0")).alias("dossier_number"), F.col("c_name").alias("full_name"),
        F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("X").alias("gender"), age.alias("age"),
        F.concat(F.lit("city "), "c_nationkey").alias("origin"), F.col("c_mktsegment").alias("principal_diagnosis"),
        F.concat(F.lit("Dr "), (k % 13).cast("string")).alias("treating_doctor"),
        F.timestamp_seconds(F.lit(1700000000) + k * 3600).alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        F.when(k % 2 == 0, F.array(F.lit("urgent"), F.lit("suivi"))).alias("tags"),
    )


def reports(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), "o_orderkey", F.lit(".docx")).alias("filename"),
        F.col("o_orderpriority").alias("patient_name"), F.col("o_orderstatus").alias("doctor_name"),
        F.lit("none").alias("pathology"), F.concat_ws(" ", F.lit("total"), F.col("o_totalprice").cast("int")).alias("content_text"),
        F.lit(5).alias("char_count"), F.col("o_custkey").alias("dossier_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


_DOSSIER_SQL = """
dos AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS dossier_number, c_name AS full_name,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) || ' mois' ELSE (c_custkey % 19) || ' ans' END AS age,
  'city ' || c_nationkey AS origin, c_mktsegment AS principal_diagnosis, 'Dr ' || (c_custkey % 13) AS treating_doctor,
  epoch_ms((1700000000 + c_custkey * 3600) * 1000) AS created_at FROM customer)
"""


@query(
    "report_search",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR 'r' || o_orderkey || '.docx' ILIKE '%urgent%'
  OR o_orderstatus ILIKE '%urgent%' OR ('total ' || CAST(trunc(o_totalprice) AS BIGINT)) ILIKE '%urgent%'""",
)
def report_search(t: Tables) -> DataFrame:
    """R1 + R2."""
    return R.newest_first(R.search(reports(t), "Urgent")).select("id")


@query(
    "document_search",
    "SELECT doc_id, source FROM documents WHERE text ILIKE '%edre%' OR source ILIKE '%edre%'",
)
def document_search(t: Tables) -> DataFrame:
    """R2 over the documents."""
    return R.search(t.documents, "EDre", ["text", "source"]).select("doc_id", "source")


SEARCHED = ["EDre", "urgent", " the ", "example", "licen_e", "zq", "no such words", "Th%ou on"]


@query(
    "indexed_search",
    " UNION ALL ".join(f"SELECT '{q.strip()}' AS query, doc_id FROM documents WHERE text ILIKE '%{q.strip()}%' OR source ILIKE '%{q.strip()}%' OR lang ILIKE '%{q.strip()}%'" for q in SEARCHED),
)
def indexed_search(t: Tables) -> DataFrame:
    """R2 by posting lists: several searches of the documents at once, over an index written before."""
    import uuid

    index = SearchIndex.build(t.documents, f"{durable_folder(t.spark)}/search-{uuid.uuid4().hex}", "doc_id", ["text", "source", "lang"])
    return index.search(SEARCHED)


@query(
    "facet_filter",
    f"WITH {_DOSSIER_SQL} SELECT id, full_name FROM dos WHERE principal_diagnosis = 'BUILDING' AND gender = 'F' AND created_at >= TIMESTAMP '2023-11-20' AND created_at <= TIMESTAMP '2023-12-31 23:59:59'",
)
def facet_filter(t: Tables) -> DataFrame:
    """R3."""
    rows = R.filter_facets(dossiers(t), {"principal_diagnosis": "BUILDING", "gender": "F", "origin": None}, "2023-11-20", "2023-12-31")
    return rows.select("id", "full_name")


@query(
    "facet_values",
    f"WITH {_DOSSIER_SQL} SELECT DISTINCT 'principal_diagnosis' AS facet, principal_diagnosis AS value FROM dos UNION SELECT 'origin', origin FROM dos UNION SELECT 'treating_doctor', treating_doctor FROM dos",
)
def facet_values(t: Tables) -> DataFrame:
    """R4."""
    return R.facet_values(dossiers(t), ["principal_diagnosis", "origin", "treating_doctor"])


@query(
    "dossier_children",
    """
SELECT c_custkey AS id, count(o_orderkey) AS n_reports, max(o_orderdate) AS newest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest_id,
  (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_notes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def dossier_children(t: Tables) -> DataFrame:
    """Dossiers with reports and notes, newest first."""
    notes = t.events.select(F.col("user_id").alias("dossier_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_id")
    nested = R.nest_children(dossiers(t).select("id"), {"reports": reports(t).select("id", "dossier_id", "created_at").withColumnRenamed("id", "report_id"), "notes": notes})
    first = F.get("reports", F.lit(0))
    return nested.select(
        "id", F.size("reports").cast("long").alias("n_reports"), first["created_at"].cast("timestamp_ntz").alias("newest"),
        first["report_id"].alias("newest_id"), F.size("notes").cast("long").alias("n_notes"),
    )


@query(
    "incremental_sync",
    """SELECT count(*) FILTER (fresh AND length(text) >= 50) AS synced, count(*) - count(*) FILTER (fresh AND length(text) >= 50) AS skipped, count(*) AS total
FROM (SELECT text, doc_id NOT IN (SELECT doc_id FROM labels) AS fresh FROM documents)""",
)
def incremental_sync(t: Tables) -> DataFrame:
    """Documents not yet labelled are new files."""
    name = F.concat(F.lit("f"), "doc_id", F.lit(".txt"))
    files = t.documents.select(name.alias("filename"), F.col("n_chars").alias("file_size_bytes"), "text")
    return R.sync_new(files, t.labels.select(name.alias("filename")))[1]


def _batch(t: Tables) -> DataFrame:
    """Incoming rows from suppliers: known by number, known by part of a name, new."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("row_id"), F.when(k % 3 == 0, F.lpad((k * 2).cast("string"), 6, "0")).when(k % 5 == 0, F.concat(F.lit("N"), (k % 4).cast("string"))).alias("dossier_number"),
        F.when(k % 3 == 1, F.concat(F.lit("#00000"), F.lpad(k.cast("string"), 4, "0"))).otherwise(F.concat(F.lit("Unknown "), (k % 9).cast("string"))).alias("full_name"),
    )


_BATCH_SQL = f"""
{_DOSSIER_SQL}, b AS (SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey * 2 AS VARCHAR), 6, '0') WHEN s_suppkey % 5 = 0 THEN 'N' || (s_suppkey % 4) END AS num,
  CASE WHEN s_suppkey % 3 = 1 THEN '#00000' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') ELSE 'Unknown ' || (s_suppkey % 9) END AS name FROM supplier),
m1 AS (SELECT row_id, min(dos.id) AS did FROM b JOIN dos ON num = dossier_number GROUP BY row_id),
m2 AS (SELECT row_id, min(dos.id) AS did FROM b JOIN dos ON contains(lower(dos.full_name), lower(b.name)) WHERE row_id NOT IN (SELECT row_id FROM m1) GROUP BY row_id),
mm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)
"""


@query("dossier_match", f"WITH {_BATCH_SQL} SELECT row_id, did AS dossier_id FROM mm")
def dossier_match(t: Tables) -> DataFrame:
    """R7, matching: by number, else by contained name."""
    return R.match_dossiers(_batch(t), dossiers(t))


@query(
    "dossier_upsert",
    f"""WITH {_BATCH_SQL}, fr AS (SELECT *, coalesce('n:' || num, 'p:' || lower(name)) AS g FROM b WHERE row_id NOT IN (SELECT row_id FROM mm))
SELECT sha256(g) AS id, min(row_id) AS row_id, arg_min(name, row_id) AS full_name FROM fr GROUP BY g""",
)
def dossier_upsert(t: Tables) -> DataFrame:
    """R7, inserts: every unmatched group once."""
    return R.upsert_dossiers(_batch(t), dossiers(t))[0].select("id", "row_id", "full_name")


@query(
    "number_check",
    f"""WITH {_BATCH_SQL}, r AS (SELECT *, num IN (SELECT dossier_number FROM dos WHERE dossier_number IS NOT NULL) AS taken, row_number() OVER (PARTITION BY num ORDER BY row_id) AS rn FROM b)
SELECT row_id, num IS NULL OR (NOT taken AND rn = 1) AS accepted FROM r""",
)
def number_check(t: Tables) -> DataFrame:
    """R8."""
    ok, bad = R.split_unique(_batch(t), dossiers(t))
    return ok.select("row_id", F.lit(True).alias("accepted")).unionByName(bad.select("row_id", F.lit(False).alias("accepted")))


@query(
    "partial_update",
    f"""WITH {_DOSSIER_SQL}, u AS (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'city X' END AS origin, 'Dr New' AS doc FROM supplier)
SELECT dos.id, coalesce(u.origin, dos.origin) AS origin, coalesce(u.doc, treating_doctor) AS treating_doctor, full_name, u.id IS NOT NULL AS stamped FROM dos LEFT JOIN u ON dos.id = u.id""",
)
def partial_update(t: Tables) -> DataFrame:
    """Ids and unknown columns of the changes table are ignored."""
    u = t.supplier.select(
        (F.col("s_suppkey") * 3).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "city X").alias("origin"), F.lit("Dr New").alias("treating_doctor"),
        F.lit("no").alias("dossier_number"),
    )
    out = R.apply_updates(dossiers(t), u, stamp=F.to_timestamp(F.lit("2024-01-01")))
    return out.select("id", "origin", "treating_doctor", "full_name", F.col("updated_at").isNotNull().alias("stamped"))


@query(
    "delete_unlink",
    """SELECT o_orderkey AS id, CASE WHEN o_custkey NOT IN (SELECT s_suppkey * 5 FROM supplier) THEN o_custkey END AS dossier_id,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 5 FROM supplier)) AS parents_left FROM orders""",
)
def delete_unlink(t: Tables) -> DataFrame:
    """R10."""
    ids = t.supplier.select((F.col("s_suppkey") * 5).alias("id"))
    kept, children = R.delete_parents(dossiers(t), reports(t), ids)
    return children.select("id", "dossier_id", F.lit(kept.count()).cast("long").alias("parents_left"))


@query(
    "tag_merge",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 IN (0, 1) THEN array_to_string(list_sort(list_concat(
    CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 7 = 1 THEN ['suivi'] ELSE ['urgent', 'suivi'] END ELSE [] END, CASE WHEN c_custkey % 7 = 0 THEN ['nouveau'] ELSE [] END)), ',')
  WHEN c_custkey % 2 = 0 THEN 'suivi,urgent' END AS tags FROM customer""",
)
def tag_merge(t: Tables) -> DataFrame:
    """R11."""
    k = F.col("c_custkey")
    changes = t.customer.select(
        k.alias("id"), F.when(k % 7 == 0, " Nouveau ").when(k % 7 == 1, "urgent").alias("tag"), F.when(k % 7 == 0, "add").when(k % 7 == 1, "remove").alias("action")
    ).where("tag is not null")
    return R.merge_tags(dossiers(t), changes).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(
    "dashboard_kpis",
    f"""WITH {_DOSSIER_SQL} SELECT count(*) AS total_dossiers, count(DISTINCT principal_diagnosis) AS unique_diagnoses, count(DISTINCT origin) AS unique_cities, count(dossier_number) AS with_number,
  (SELECT count(*) FROM orders) AS total_reports, CAST(round(CAST((SELECT count(*) FROM orders) AS DOUBLE) / count(*), 1) AS DOUBLE) AS reports_per_dossier FROM dos""",
)
def dashboard_kpis(t: Tables) -> DataFrame:
    """R12."""
    return R.kpis(dossiers(t), reports(t))


@query(
    "category_histograms",
    f"""WITH {_DOSSIER_SQL}, l AS (SELECT 'gender' AS chart, CASE gender WHEN 'M' THEN 'Masculin' WHEN 'F' THEN 'Féminin' ELSE 'Inconnu' END AS label FROM dos
  UNION ALL SELECT 'diagnosis', principal_diagnosis FROM dos UNION ALL SELECT 'city', origin FROM dos)
SELECT chart, label, count(*) AS value FROM l GROUP BY ALL""",
)
def category_histograms(t: Tables) -> DataFrame:
    """R13."""
    d = dossiers(t)
    charts_ = {"gender": R.gender_label(F.col("gender")), "diagnosis": R.cut_label(F.col("principal_diagnosis")), "city": F.col("origin")}
    out = None
    for name, label in charts_.items():
        h = R.histogram(d, label).select(F.lit(name).alias("chart"), "label", "value")
        out = h if out is None else out.unionByName(h)
    return out


@query(
    "source_histogram",
    "SELECT CASE WHEN length(text) > 35 THEN text[1:35] || '…' ELSE text END AS label, count(*) AS value FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
)
def source_histogram(t: Tables) -> DataFrame:
    """Long labels cut, the eight most frequent."""
    return R.histogram(t.documents, R.cut_label(F.col("text")), 8)


@query(
    "monthly_trend",
    """SELECT CAST(m AS DATE) AS month, (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = m) AS value
FROM (SELECT unnest(generate_series(TIMESTAMP '2001-05-01', TIMESTAMP '2001-10-01', INTERVAL 1 MONTH)) AS m)""",
)
def monthly_trend(t: Tables) -> DataFrame:
    """The last two months have no reports."""
    return R.monthly_trend(reports(t), "2001-10-15")


@query(
    "age_buckets",
    f"""WITH {_DOSSIER_SQL}, y AS (SELECT CASE WHEN contains(age, 'mois') THEN CAST(regexp_extract(age, '(\\d+)', 1) AS DOUBLE) / 12 ELSE CAST(regexp_extract(age, '(\\d+)', 1) AS DOUBLE) END AS y FROM dos WHERE age IS NOT NULL)
SELECT CASE WHEN y < 1 THEN '0-1 an' WHEN y < 3 THEN '1-3 ans' WHEN y < 6 THEN '3-6 ans' WHEN y < 12 THEN '6-12 ans' ELSE '12+ ans' END AS label, count(*) AS value FROM y GROUP BY 1""",
)
def age_buckets(t: Tables) -> DataFrame:
    """R15."""
    return R.age_histogram(dossiers(t))


@query("most_recent", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def most_recent(t: Tables) -> DataFrame:
    """R16."""
    return R.most_recent(reports(t)).select("id")


_LET = "translate(lpad(CAST({0} AS VARCHAR), 6, '0'), '0123456789', 'abcdefghij')"


@query(
    "link_reports",
    f"""SELECT c_custkey AS dossier_id, upper({_LET.format('c_custkey')}[1]) || {_LET.format('c_custkey')}[2:] || ' Zed' AS patient_name, 'Durand' AS doctor_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'SCID' ELSE c_mktsegment END AS pathology FROM customer""",
)
def link_reports(t: Tables) -> DataFrame:
    """Metadata from the file name, else from the dossier."""
    files = charts(t).select("filename", "text", F.length("text").alias("file_size_bytes"), F.col("c_custkey").alias("dossier_id"))
    return R.link_reports(files, dossiers(t)).select("dossier_id", "patient_name", "doctor_name", "pathology")


@query(
    "report_changes",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN length('new text ' || o_orderkey) ELSE 5 END AS char_count,
  CASE WHEN o_orderkey % 4 = 0 THEN 'new text ' || o_orderkey ELSE 'total ' || CAST(trunc(o_totalprice) AS BIGINT) END AS content_text FROM orders WHERE o_orderkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def report_changes(t: Tables) -> DataFrame:
    """R19."""
    contents = t.orders.select(
        F.concat(F.lit("r"), "o_orderkey", F.lit(".docx")).alias("filename"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("new text "), "o_orderkey")).alias("content_text"),
    ).where("content_text is not null")
    out = R.change_reports(reports(t), t.supplier.select(F.col("s_suppkey").alias("id")), contents)
    return out.select("id", "char_count", "content_text")


@query(
    "report_notes",
    "SELECT 'REPORT_' || CAST(doc_id AS VARCHAR) AS note_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(trim(text, E' \\t\\n\\r\\f\\x0B')) > 0 GROUP BY 1",
)
def report_notes(t: Tables) -> DataFrame:
    """R20, input half: stored reports as notes for a run."""
    notes = R.notes_from_reports(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content_text")))
    return notes.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "dossier_build",
    f"""SELECT upper({_LET.format('c_custkey')}[1]) || {_LET.format('c_custkey')}[2:] || ' Zed' AS full_name, CASE WHEN c_custkey % 2 = 1 THEN 'F' ELSE 'M' END AS gender,
  lower(c_mktsegment) AS principal_diagnosis, CASE WHEN c_custkey % 5 = 0 THEN 'Martin' ELSE 'Durand' END AS treating_doctor FROM customer""",
)
def dossier_build(t: Tables) -> DataFrame:
    """R21."""
    ok, _ = R.build_dossiers(charts(t).select("filename", "text"))
    return ok.select("full_name", "gender", "principal_diagnosis", "treating_doctor")


# ------------------------------------------------------------ cases, streams
@query(
    "longest_cases",
    "SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3",
)
def longest_cases(t: Tables) -> DataFrame:
    """The three longest documents per source."""
    return longest_per_group(t.documents.select("source", "doc_id", "n_chars"), "source", 3, "n_chars", "doc_id").select("source", "doc_id", "rank")


@query(
    "numbered_cases",
    "SELECT doc_id, 'CASE_' || printf('%03d', row_number() OVER (ORDER BY source, n_chars, doc_id)) AS note_id FROM documents",
)
def numbered_cases(t: Tables) -> DataFrame:
    """Sequential ids without a global sort task."""
    return number_cases(t.documents.select("doc_id", "source", "n_chars"), ["source", "n_chars", "doc_id"], "CASE_").select("doc_id", "note_id")


@query(
    "stream_redaction",
    "WITH " + _phi_sql(RULES)
    + """, v AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_values FROM documents LEFT JOIN v USING (doc_id) WHERE length(trim(text, E' \\t\\n\\r\\f\\x0B')) >= 50""",
)
def stream_redaction(t: Tables) -> DataFrame:
    """T1, row-local half: the documents arrive as a stream, replays are dropped,
    short notes rejected, personal data redacted, results appended."""
    import uuid

    from chartweave.operators import phi
    from chartweave.streaming.notes import accept

    folder = f"{durable_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    # A pattern takes the table as one file and as a folder of files; a stream's plain path must be a folder.
    src = t.spark.readStream.schema("doc_id long, text string").parquet(f"{t.folder}/documents.parque[t]")
    notes = src.select(F.col("doc_id").alias("note_id"), "text", F.to_timestamp(F.lit("2024-01-01")).alias("received_at"))
    clean = phi.redact(accept(notes).withColumn("language", F.lit("x")), "text", {"x": RULES}, flags="")
    q = (
        clean.select(F.col("note_id").alias("doc_id"), F.size("phi").alias("n_values")).writeStream.format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema("doc_id long, n_values int").parquet(f"{folder}/out")


@query(
    "stream_dossiers",
    "WITH " + _phi_sql(RULES)
    + """, v AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
  k AS (SELECT source || '-' || (doc_id % 20) AS dossier_number, doc_id, 1704067200000 + (doc_id * 7919 % 80000) * 1000 AS ms, coalesce(n, 0) AS n
    FROM documents LEFT JOIN v USING (doc_id))
  SELECT dossier_number, count(*) AS n_reports, arg_min(CAST(doc_id AS VARCHAR), (ms, CAST(doc_id AS VARCHAR))) AS first_report, max(ms)::BIGINT AS newest_ms, sum(n)::BIGINT AS n_values
  FROM k GROUP BY dossier_number""",
)
def stream_dossiers(t: Tables) -> DataFrame:
    """T1 + R7 as a keyed stream: documents arrive in three runs of it, some newest first,
    with replays and superseded revisions in between; the dossiers equal a batch run."""
    import uuid

    from chartweave.operators import phi
    from chartweave.streaming.dossiers import current_reports, follow_dossiers, upserted_dossiers

    folder = f"{durable_folder(t.spark)}/dossiers-{uuid.uuid4().hex}"
    k = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + k * 7919 % 80000)
    notes = t.documents.select(k.cast("string").alias("note_id"), F.concat_ws("-", "source", k % 20).alias("dossier_number"), "text", at.alias("received_at"), k.alias("_k"))
    # Older revisions: another text and a time of up to an hour before.
    stale = notes.withColumn("text", F.lit("superseded 01/02/2003")).withColumn("received_at", F.col("received_at") - F.expr("make_interval(0, 0, 0, 0, 0, 1 + _k % 59)"))
    arrivals = [stale.where("_k % 2 = 0"), notes, notes.where("_k % 3 = 0").unionByName(stale.where("_k % 5 = 0"))]
    def score(rows: DataFrame) -> DataFrame:
        clean = phi.redact(rows.withColumn("language", F.lit("x")), "text", {"x": RULES}, flags="")
        return clean.select("dossier_number", "note_id", "at_ms", "digest", F.size("phi").cast("long").alias("n_values"))

    for part in arrivals:  # every arrival restarts the stream from its checkpoint
        part.drop("_k").write.mode("append").parquet(f"{folder}/in")
        src = t.spark.readStream.schema(part.drop("_k").schema).parquet(f"{folder}/in")
        follow_dossiers(src, score, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    rows = t.spark.read.schema("dossier_number string, note_id string, at_ms long, digest string, n_values long").parquet(f"{folder}/out")
    return upserted_dossiers(current_reports(rows), ["n_values"])


@query("note_run")
def note_run(t: Tables) -> DataFrame:
    """The whole plan over all documents: phrases of the benchmark are the
    lexicon, their first letters the ontology, their last letters the diseases."""
    from chartweave.operators.normalize import Dictionaries
    from chartweave.plans.pipeline import Dimensions, Options, Pipeline

    terms = bigrams(t)
    concept = F.concat(F.lit("C:"), "term")
    lookup = terms.select("term", concept.alias("concept_id"), F.col("term").alias("name"), F.lit("exact_label").alias("match_type"))
    head, pair = F.concat(F.lit("H:"), F.substring("term", 1, 1)), F.concat(F.lit("P:"), F.substring("term", 1, 2))
    edges = terms.select(concept.alias("child"), pair.alias("parent")).union(terms.select(pair, head)).union(terms.select(head, F.lit("root"))).distinct()
    disease = F.concat(F.lit("D:"), F.substring("term", -2, 2), F.length("term"))
    profiles = terms.select(disease.alias("disease_id"), F.concat(F.lit("disease of "), disease).alias("name"), concept.alias("concept_id"))
    dims = Dimensions(Dictionaries(lookup), None, edges, profiles, phi_rules={"fr": RULES, "en": RULES})
    run = Pipeline(dims, Options()).run(t.documents.select(F.col("doc_id").cast("string").alias("note_id"), "text"))
    p = "phenopacket"
    return run.documents.select(
        F.col("note_id").cast("long").alias("doc_id"), F.size(f"{p}.phenotypicFeatures").alias("n_features"), f"{p}.target",
        f"{p}._pipelineStats.matchedHPO", f"{p}._pipelineStats.ordoCandidates",
    )


