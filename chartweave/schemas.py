"""Explicit schemas of the input and dimension tables."""

NOTES = "note_id string, text string, filename string, source string, forced_lang string"
GOLD = "note_id string, disease string, disease_id string, expected array<string>"
LABELLED_CORPUS = (
    "note_id string, text string, source_file string, disease string, orpha_id string, expected_hpo array<string>"
)
CASES = (
    "note_id string, pmid string, disease string, orpha_id string, title string, text string, source string, "
    "word_count int, journal string, year string, authors array<string>"
)
CONCEPTS = (
    "id string, name string, definition string, exact_synonyms array<string>, related_synonyms array<string>, "
    "xrefs array<string>, ord bigint"
)
EDGES = "child string, parent string"
PROFILES = "disease_id string, name string, concept_id string"
LABELS_FR = "term string, concept_id string, name string"
ABBREVIATIONS = "key string, expansion string, lang string, priority int"
EDGE_GRAPH = "graphs array<struct<edges:array<struct<sub:string,pred:string,obj:string>>>>"
OWL_CLASS = (
    "`_rdf:about` string, `oboInOwl:id` string, "
    "`rdfs:label` string, `obo:IAO_0000115` string, "
    "`oboInOwl:hasExactSynonym` array<string>, `oboInOwl:hasRelatedSynonym` array<string>, "
    "`oboInOwl:hasDbXref` array<string>"
)
REPORTS = (
    "id string, filename string, patient_name string, doctor_name string, pathology string, report_date date, "
    "file_size_bytes bigint, char_count int, content_text string, dossier_id string, created_at timestamp"
)
ENTITIES = (
    "note_id string, category string, seq int, text string, score double, start int, end int, source string"
)
