"""Sources and sinks: each query writes a source's format from the tables with Spark and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions.text import strip
from chartweave.operators import reports as R
from chartweave.plans.registry import Tables, query
from chartweave.session import durable_folder
from chartweave.sources import archives, articles, corpora, ontology, report_files, sinks

_URI = "http://purl.obolibrary.org/obo/HP_"
_SPACE = "E' \\t\\n\\r\\f\\x0B'"


def _folder(t: Tables, name: str) -> str:
    return f"{durable_folder(t.spark)}/sources/{name}_{uuid.uuid4().hex}"


def _key(c: str = "doc_id"):
    return F.col(c).cast("string")


@query(
    "labelled_corpus",
    "SELECT CAST(doc_id AS VARCHAR) AS note_id, source AS filename, CAST(length(text) AS INTEGER) AS chars, lang AS disease, 'D:' || lang AS disease_id, "
    "'H:' || CAST(doc_id % 7 AS VARCHAR) AS first_expected, 2 AS n_expected FROM documents",
)
def labelled_corpus(t: Tables) -> DataFrame:
    """Notes and gold of JSON lines."""
    path = _folder(t, "labelled")
    t.documents.select(
        _key().alias("note_id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("disease"),
        F.concat(F.lit("D:"), "lang").alias("orpha_id"),
        F.array(F.concat(F.lit("H:"), (F.col("doc_id") % 7).cast("string")), F.lit("H:x")).alias("expected_hpo"),
    ).write.json(path)
    notes, gold = corpora.labelled_corpus(t.spark, path, lines=True)
    return notes.select("note_id", "filename", F.length("text").alias("chars")).join(
        gold.select("note_id", "disease", "disease_id", F.get("expected", F.lit(0)).alias("first_expected"), F.size("expected").alias("n_expected")), "note_id"
    )


@query(
    "case_corpus",
    "SELECT disease, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(n_chars)::BIGINT AS word_sum, count(DISTINCT source) AS journals FROM (SELECT lang AS disease, * FROM documents) GROUP BY disease",
)
def case_corpus(t: Tables) -> DataFrame:
    """Case reports of JSON lines; a missing path adds an empty corpus."""
    path = _folder(t, "cases")
    t.documents.select(
        _key().alias("note_id"), _key().alias("pmid"), F.col("lang").alias("disease"), "text", F.col("source").alias("journal"),
        F.col("n_chars").cast("int").alias("word_count"), F.array("source").alias("authors"),
    ).write.json(path)
    cases = corpora.case_corpus(t.spark, path, lines=True).unionByName(corpora.case_corpus(t.spark, f"{path}_missing"))
    return cases.groupBy("disease").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("word_count").alias("word_sum"),
        F.count_distinct("journal").alias("journals"),
    )


@query(
    "article_files",
    f"""SELECT CAST(doc_id AS VARCHAR) AS pmid, 'T' || CAST(doc_id AS VARCHAR) AS title, source AS journal, CASE WHEN doc_id % 2 = 0 THEN '2020' ELSE '1999' END AS year,
  3 AS n_authors, CAST(len(string_split_regex(trim(a, {_SPACE}), '\\s+')) AS INTEGER) AS word_count
  FROM (SELECT *, 'AIM: ' || trim(text, {_SPACE}) || chr(10) || 'end' AS a FROM documents) WHERE length(a) > 200""",
)
def article_files(t: Tables) -> DataFrame:
    """S3: articles of an XML file with labelled abstract parts and both date forms."""
    path = _folder(t, "articles")
    even = F.col("doc_id") % 2 == 0
    author = F.struct(F.lit("A").alias("LastName"), F.lit("F").alias("ForeName"))
    none = F.lit(None).cast("string")
    article = F.struct(
        F.concat(F.lit("T"), _key()).alias("ArticleTitle"),
        F.struct(F.array(
            F.struct(strip(F.col("text")).alias("_VALUE"), F.lit("AIM").alias("_Label")), F.struct(F.lit("end").alias("_VALUE"), none.alias("_Label")),
        ).alias("AbstractText")).alias("Abstract"),
        F.struct(F.col("source").alias("Title"), F.struct(F.struct(
            F.when(even, "2020").alias("Year"), F.when(~even, "1999 Jan").alias("MedlineDate")
        ).alias("PubDate")).alias("JournalIssue")).alias("Journal"),
        F.struct(F.array(author, author, author, author).alias("Author")).alias("AuthorList"),
    )
    pmid = F.struct(_key().alias("_VALUE"), F.lit("1").alias("_Version"))
    t.documents.select(F.struct(pmid.alias("PMID"), article.alias("Article")).alias("MedlineCitation")).write.format("xml").option(
        "rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").option("attributePrefix", "_").option("valueTag", "_VALUE").save(path)
    return articles.read_articles(t.spark, path).select(
        "pmid", "title", "journal", "year", F.size("authors").alias("n_authors"), F.col("word_count").cast("int").alias("word_count")
    )


@query(
    "report_folder",
    "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM conversations",
)
def report_folder(t: Tables) -> DataFrame:
    """Text files of a folder; every conversation turn is a stretch between marks."""
    path = _folder(t, "reports")
    t.conversations.select(F.concat("text", F.lit("\x1e")).alias("value")).write.option("lineSep", "\x1f").text(path)
    files = report_files.read_reports(t.spark, path, "txt")
    turns = files.select(F.explode(F.split("text", "\x1e\x1f")).alias("turn")).where(F.length("turn") > 0)
    return turns.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("turn")).alias("chars"), F.max(F.length("turn")).cast("long").alias("longest")
    )


@query(
    "concept_file",
    "SELECT 'HP:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, p_name AS name, p_type AS definition, [p_name || ' one', p_brand] AS exact_synonyms, "
    "CASE WHEN p_partkey % 2 = 0 THEN [p_mfgr] ELSE [] END AS related_synonyms, ['UMLS:C' || CAST(p_partkey AS VARCHAR)] AS xrefs "
    "FROM (SELECT *, 'M' || CAST(p_partkey % 5 AS VARCHAR) AS p_mfgr FROM part) WHERE p_partkey % 3 <> 0",
)
def concept_file(t: Tables) -> DataFrame:
    """Concepts of an ontology file; obsolete classes are left out."""
    path = _folder(t, "concepts")
    key = _key("p_partkey")
    number = F.lpad(key, 7, "0")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Obsolete "), "p_name")).otherwise(F.col("p_name"))
    related = tag("oboInOwl:hasRelatedSynonym", F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string")))
    element = F.concat(
        F.lit(f'<owl:Class rdf:about="{_URI}'), number, F.lit('">'), tag("oboInOwl:id", F.concat(F.lit("HP:"), number)), tag("rdfs:label", label),
        tag("obo:IAO_0000115", F.col("p_type")), tag("oboInOwl:hasExactSynonym", F.concat("p_name", F.lit(" one"))),
        tag("oboInOwl:hasExactSynonym", F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, related).otherwise(""),
        tag("oboInOwl:hasDbXref", F.concat(F.lit("UMLS:C"), key)), F.lit("</owl:Class>"),
    )
    # Some hundred classes to a file, each with its own root.
    files = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.array_join(F.collect_list(element), "\n").alias("rows"))
    root = 'xmlns:owl="urn:owl" xmlns:rdf="urn:rdf" xmlns:rdfs="urn:rdfs" xmlns:obo="urn:obo" xmlns:oboInOwl="urn:in"'
    files.select("g", F.concat(F.lit(f"<rdf:RDF {root}>\n"), "rows", F.lit("\n</rdf:RDF>")).alias("value")).write.partitionBy("g").text(path)
    return ontology.read_concepts(t.spark, path).drop("ord")


@query(
    "edge_file",
    "SELECT 'HP:c' || CAST(c_custkey AS VARCHAR) AS child, 'HP:n' || CAST(c_nationkey AS VARCHAR) AS parent FROM customer WHERE c_custkey % 4 <> 0",
)
def edge_file(t: Tables) -> DataFrame:
    """Edges of JSON graphs, one of a bounded size per file; other relations are left out."""
    path = _folder(t, "edges")
    uri = lambda mark, c: F.concat(F.lit(_URI + mark), F.col(c).cast("string"))
    edge = F.struct(
        uri("c", "c_custkey").alias("sub"), F.when(F.col("c_custkey") % 4 == 0, "part_of").otherwise("is_a").alias("pred"), uri("n", "c_nationkey").alias("obj")
    )
    graphs = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("g")).agg(F.collect_list(edge).alias("edges"))
    graphs.select("g", F.array(F.struct("edges")).alias("graphs")).write.partitionBy("g").json(path)
    return ontology.read_edges(t.spark, path)


@query(
    "annotation_file",
    "SELECT DISTINCT 'ORPHA:' || CAST(l_suppkey AS VARCHAR) AS disease_id, 'Name \"' || CAST(l_suppkey AS VARCHAR) AS name, 'HP:' || CAST(l_partkey AS VARCHAR) AS concept_id FROM lineitem WHERE l_linenumber % 3 <> 0",
)
def annotation_file(t: Tables) -> DataFrame:
    """Profiles of a TSV with comments, negated rows and odd quotes in names."""
    path = _folder(t, "annotations")
    t.lineitem.select(F.concat_ws(
        "\t", F.concat(F.lit("ORPHA:"), F.col("l_suppkey").cast("string")), F.concat(F.lit('Name "'), F.col("l_suppkey").cast("string")),
        F.when(F.col("l_linenumber") % 3 == 0, "NOT").otherwise(""), F.concat(F.lit("HP:"), F.col("l_partkey").cast("string")),
    ).alias("value")).write.text(path)
    return ontology.read_annotations(t.spark, path)


@query(
    "annotation_totals",
    "WITH p AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS diseases, CAST(round(avg(n), 1) AS DOUBLE) AS avg_terms, min(n) AS min_terms, max(n) AS max_terms FROM p",
)
def annotation_totals(t: Tables) -> DataFrame:
    """Sizes of profiles."""
    return ontology.annotation_stats(t.lineitem.select(F.col("l_suppkey").alias("disease_id"), F.col("l_partkey").alias("concept_id")))


@query(
    "french_label_files",
    "SELECT lower(p_name) || ' ' || CAST(p_partkey AS VARCHAR) AS term, 'HP:' || CAST(p_partkey AS VARCHAR) AS concept_id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS name FROM part",
)
def french_label_files(t: Tables) -> DataFrame:
    """Labels of one TSV, synonyms of another for terms without a label."""
    key = _key("p_partkey")

    def write(rows: DataFrame, name) -> str:
        path = _folder(t, "labels")
        blank = [F.lit("").alias(c) for c in "abcd"]
        rows.select(
            F.concat(F.lit("HP:"), key).alias("id"), *blank, name.alias("en"), F.lit("").alias("e"), F.concat("p_name", F.lit(" "), key).alias("fr")
        ).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
        return path

    labels = write(t.part.where(F.col("p_partkey") % 3 != 0), F.col("p_brand"))
    return ontology.read_french_labels(t.spark, labels, write(t.part, F.col("p_type")))


@query(
    "abbreviation_files",
    "SELECT 'k' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'late ' ELSE '' END || c_mktsegment AS expansion FROM customer WHERE length(CAST(c_custkey AS VARCHAR)) <= 9",
)
def abbreviation_files(t: Tables) -> DataFrame:
    """Of equal keys the last folder wins."""
    paths = [_folder(t, "abbreviations"), _folder(t, "abbreviations")]
    key = F.concat(F.lit("K"), F.col("c_custkey").cast("string"))
    t.customer.select(key, "c_mktsegment").write.csv(f"{paths[0]}/early")
    t.customer.where("c_custkey % 2 = 0").select(key, F.concat(F.lit("late "), "c_mktsegment")).write.csv(f"{paths[1]}/late")
    return ontology.read_abbreviations(t.spark, [f"{paths[0]}/early", f"{paths[1]}/late"])


@query("saved_outputs", "SELECT CAST(doc_id AS VARCHAR) AS note_id, CAST(length(text) AS INTEGER) AS chars, true AS named FROM documents")
def saved_outputs(t: Tables) -> DataFrame:
    """Saved result documents with the file that holds them."""
    path = _folder(t, "outputs")
    t.documents.select(_key().alias("note_id"), "text").write.json(path)
    rows = corpora.saved_outputs(t.spark, path, "note_id string, text string", "part-*.json", lines=True)
    return rows.select("note_id", F.length("text").alias("chars"), F.col("file_name").startswith("part-").alias("named"))


@query(
    "gold_forms",
    "SELECT CAST(doc_id AS VARCHAR) AS note_id, lang AS disease, source AS disease_id, ['H:' || CAST(doc_id AS VARCHAR)] AS expected FROM documents",
)
def gold_forms(t: Tables) -> DataFrame:
    """Gold as a list, an object keyed by id and a list of objects."""
    key = F.concat(F.lit('"H:'), _key(), F.lit('"'))
    form = F.col("doc_id") % 3
    raw = F.when(form == 0, F.concat(F.lit("["), key, F.lit("]"))).when(form == 1, F.concat(F.lit("{"), key, F.lit(': "n"}'))).otherwise(
        F.concat(F.lit('[{"hpo_id": '), key, F.lit(', "n": 1}]'))
    )
    return corpora.gold_table(t.documents.select(
        _key().alias("note_id"), F.col("lang").alias("disease"), F.col("source").alias("orpha_id"), raw.alias("expected_hpo")
    ))


@query("document_sink", "SELECT CAST(doc_id AS VARCHAR) AS note_id, lang, CAST(length(text) AS INTEGER) AS chars FROM documents")
def document_sink(t: Tables) -> DataFrame:
    """K1: nested documents as Parquet."""
    path = _folder(t, "documents")
    sinks.write_documents(t.documents.select(_key().alias("note_id"), F.struct("lang", "text").alias("phenopacket")), path)
    return t.spark.read.parquet(path).select("note_id", "phenopacket.lang", F.length("phenopacket.text").alias("chars"))


@query("note_json", "SELECT CAST(s_suppkey AS VARCHAR) AS note, s_suppkey AS suppkey, CAST(NULL AS VARCHAR) AS gone FROM supplier")
def note_json(t: Tables) -> DataFrame:
    """K1: one JSON document per supplier, nulls kept."""
    path = _folder(t, "json")
    payload = F.struct("s_suppkey", F.lit(None).cast("string").alias("gone")).alias("phenopacket")
    sinks.write_note_json(t.supplier.select(F.concat(F.lit("s"), _key("s_suppkey")).alias("note_id"), payload), path)
    back = t.spark.read.text(f"{path}/phenopacket").where(F.contains("value", F.lit('"gone":null')))
    return back.select(
        F.substring("note", 2, 20).alias("note"), F.get_json_object("value", "$.s_suppkey").cast("long").alias("suppkey"), F.get_json_object("value", "$.gone").alias("gone")
    )


@query("result_append", "SELECT o_orderpriority AS language, 2 * count(*) AS n, count(DISTINCT o_orderkey) AS notes FROM orders GROUP BY o_orderpriority")
def result_append(t: Tables) -> DataFrame:
    """K2: appending twice keeps both."""
    path = _folder(t, "results")
    for _ in range(2):
        sinks.append_results(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("language")), path)
    return t.spark.read.parquet(path).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("notes"))


@query("cached_concepts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def cached_concepts(t: Tables) -> DataFrame:
    """K3: built once; the second call reads what the first wrote."""
    path = _folder(t, "cache")
    ontology.cached_table(t.spark, path, lambda: t.part.select("p_partkey", "p_type"))
    return ontology.cached_table(t.spark, path, lambda: t.part.limit(0)).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("metric_file", "SELECT count(*) AS n, max(o_orderkey) AS last FROM orders")
def metric_file(t: Tables) -> DataFrame:
    """K4: an aggregate as JSON."""
    path = _folder(t, "metrics")
    sinks.write_metrics(t.orders.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")), path)
    return t.spark.read.schema("n bigint, last bigint").json(path)


@query(
    "report_upsert",
    "SELECT 'f' || CAST(c_custkey AS VARCHAR) AS filename, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS dossier_id FROM customer",
)
def report_upsert(t: Tables) -> DataFrame:
    """R7, report half: known files get the incoming dossier, new ones are added."""
    name = F.concat(F.lit("f"), _key("c_custkey")).alias("filename")
    stored = t.customer.where("c_custkey % 3 <> 0 OR c_custkey % 2 = 1").select(name, F.when(F.col("c_custkey") % 2 == 1, "old").alias("dossier_id"))
    return R.upsert_reports(stored, t.customer.where("c_custkey % 2 = 0").select(name, F.lit("new").alias("dossier_id"))).select("filename", "dossier_id")


@query(
    "vector_archive",
    "SELECT CAST(vec_id AS VARCHAR) AS concept_id, CAST(len(embedding) AS INTEGER) AS dims, "
    "CAST(list_sum([CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding]) AS BIGINT) AS total, "
    "CAST(floor(CAST(embedding[1] AS DOUBLE) * 1048576) AS BIGINT) AS first_component FROM embeddings",
)
def vector_archive(t: Tables) -> DataFrame:
    """K3: all vectors written to a folder of NPZ archives and read back by ranges of rows."""
    path = _folder(t, "vectors")
    archives.write_vectors(t.embeddings, path, key="vec_id", vec="embedding")
    whole = lambda x, by: F.floor(x.cast("double") * by).cast("long")
    return archives.read_vectors(t.spark, path).select(
        "concept_id", F.size("vec").alias("dims"),
        F.aggregate("vec", F.lit(0).cast("long"), lambda acc, x: acc + whole(x, 1024)).alias("total"),
        whole(F.get("vec", F.lit(0)), 1048576).alias("first_component"),
    )
