"""File sources and sinks on small invented files."""

import io
import json
import zipfile

from chartweave.operators import reports as R
from chartweave.plans.pipeline import Pipeline
from chartweave.sources import articles, corpora, ontology, report_files, sinks
from chartweave.streaming.notes import read_note_stream, run_stream
from pyspark.sql import functions as F
from tests.fixtures import dims
from tests.test_pipeline import NOTES


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpora_and_gold(spark, tmp_path):
    data = [{"note_id": "a", "text": "t", "source_file": "f.docx", "disease": "D", "orpha_id": "ORPHA:1", "expected_hpo": ["HP:1"]}]
    notes, gold = corpora.labelled_corpus(spark, write(tmp_path / "g.json", json.dumps(data)))
    assert notes.first().filename == "f.docx" and gold.first().expected == ["HP:1"]
    assert corpora.case_corpus(spark, str(tmp_path / "missing.json")).count() == 0
    raw = spark.createDataFrame(
        [("a", "x", "O:1", '["HP:1","HP:2"]'), ("b", "y", "O:2", '{"HP:3": "name"}'), ("c", "z", "O:3", '[{"hpo_id": "HP:4", "n": 1}]')],
        "note_id string, disease string, orpha_id string, expected_hpo string",
    )
    assert {r.note_id: r.expected for r in corpora.gold_table(raw).collect()} == {"a": ["HP:1", "HP:2"], "b": ["HP:3"], "c": ["HP:4"]}
    by = corpora.gold_table(raw.drop("note_id"), spark.createDataFrame([("n1", "x"), ("n2", "x")], "note_id string, disease string"), "disease")
    assert sorted(r.note_id for r in by.collect()) == ["n1", "n2"]


def test_articles(spark, tmp_path):
    def art(pmid, parts, date, authors=()):
        body = "".join(f'<AbstractText{" Label=" + chr(34) + lab + chr(34) if lab else ""}>{t}</AbstractText>' for lab, t in parts)
        who = "".join(f"<Author><LastName>{a}</LastName><ForeName>F</ForeName></Author>" for a in authors)
        return (
            f"<PubmedArticle><MedlineCitation><PMID Version=\"1\">{pmid}</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate>{date}</PubDate>"
            f"</JournalIssue></Journal><ArticleTitle>T{pmid}</ArticleTitle><Abstract>{body}</Abstract><AuthorList>{who}</AuthorList></Article></MedlineCitation></PubmedArticle>"
        )

    long = "word " * 60
    xml = "<PubmedArticleSet>" + art(1, [("AIM", long), ("", "end")], "<Year>2020</Year>", "ABCD") + art(2, [("", "short")], "<Year>2020</Year>") + art(3, [("", long)], "<MedlineDate>1999 Jan</MedlineDate>") + "</PubmedArticleSet>"
    got = {r.pmid: r for r in articles.read_articles(spark, write(tmp_path / "a.xml", xml)).collect()}
    assert set(got) == {"1", "3"} and got["1"].abstract.startswith("AIM: word") and got["1"].abstract.endswith("\nend")
    assert got["3"].year == "1999" and got["1"].authors == ["A F", "B F", "C F"] and got["1"].text.startswith("Case Report: T1\n\nAIM")
    cases = spark.createDataFrame([(d, str(i), i) for d in "xy" for i in range(5)], "disease string, pmid string, word_count int")
    top = articles.longest_per_group(cases)
    assert sorted((r.disease, r.pmid) for r in top.collect()) == [(d, p) for d in "xy" for p in "234"]
    ids = [r.note_id for r in articles.number_cases(top, ["disease", "rank"], "CASE_").orderBy("disease", "rank").collect()]
    assert ids == [f"CASE_{i:03d}" for i in range(1, 7)]


def test_ontology_files(spark, tmp_path):
    ns = 'xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:obo="http://purl.obolibrary.org/obo/" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#"'
    cls = lambda i, label, extra="", ident=True: (
        f'<owl:Class rdf:about="http://purl.obolibrary.org/obo/{i}">' + (f"<oboInOwl:id>{i.replace('_', ':')}</oboInOwl:id>" if ident else "") + f"<rdfs:label>{label}</rdfs:label>{extra}</owl:Class>\n"
    )
    syn = "<oboInOwl:hasExactSynonym>one</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>two</oboInOwl:hasExactSynonym><oboInOwl:hasDbXref>UMLS:C1</oboInOwl:hasDbXref>"
    owl = f'<?xml version="1.0"?>\n<rdf:RDF {ns}>\n' + cls("HP_0000001", "All", syn) + cls("HP_0000002", "Obsolete x") + cls("GO_1", "no") + cls("HP_3", "noid", ident=False) + "</rdf:RDF>"
    got = ontology.read_concepts(spark, write(tmp_path / "o.owl", owl)).collect()
    assert [(r.id, r.name, r.exact_synonyms, r.related_synonyms, r.xrefs) for r in got] == [("HP:0000001", "All", ["one", "two"], [], ["UMLS:C1"])]

    u = "http://purl.obolibrary.org/obo/HP_"
    graph = {"graphs": [{"edges": [{"sub": u + "2", "pred": "is_a", "obj": u + "1"}, {"sub": u + "2", "pred": "part_of", "obj": u + "3"}, {"sub": "x", "pred": "is_a", "obj": u + "1"}]}]}
    assert [tuple(r) for r in ontology.read_edges(spark, write(tmp_path / "hp.json", json.dumps(graph))).collect()] == [("HP:2", "HP:1")]

    tsv = "#c\ndatabase_id\tdisease_name\tqualifier\thpo_id\textra\nORPHA:1\tName one\t\tHP:1\tx\nORPHA:1\tName two\t\tHP:2\tx\nORPHA:1\tN\tNOT\tHP:3\tx\nOMIM:1\tN\t\tHP:1\tx\nORPHA:2\tB\t\tHP:1\tx\nORPHA:9\tshort\n"
    prof = ontology.read_annotations(spark, write(tmp_path / "p.hpoa", tsv))
    assert sorted(tuple(r) for r in prof.collect()) == [("ORPHA:1", "Name one", "HP:1"), ("ORPHA:1", "Name one", "HP:2"), ("ORPHA:2", "B", "HP:1")]
    assert tuple(ontology.annotation_stats(prof).first()) == (2, 1.5, 1, 2)

    head = "id\ta\tb\tc\td\ten\te\tfr\n"
    line = lambda i, en, fr: f"{i}\t\t\t\t\t{en}\t\t{fr}\n"
    lab = write(tmp_path / "l.tsv", head + line("HP:1", "Fever", "Fièvre") + line("HP:2", "Heat", "fièvre") + line("X:1", "n", "n"))
    syn2 = write(tmp_path / "s.tsv", head + line("HP:3", "Other", "Fièvre") + line("HP:4", "Cough", "Toux") + line("HP:5", "Late", "toux"))
    assert {r.term: (r.concept_id, r.name) for r in ontology.read_french_labels(spark, lab, syn2).collect()} == {"fièvre": ("HP:2", "Heat"), "toux": ("HP:4", "Cough")}

    a = write(tmp_path / "a.csv", "BP,blood pressure\nx,too short\n")
    b = write(tmp_path / "b.csv", "bp,British Pharmacopoeia\nlonglonglonglong,no\nhr,\n")
    assert [tuple(r) for r in ontology.read_abbreviations(spark, [a, b]).collect()] == [("bp", "British Pharmacopoeia")]
    # A small file is read after a larger one, and a name may come as file:///, as Spark lists it.
    c = write(tmp_path / "c.csv", "".join(f"bp{i},later\n" for i in range(2000)))
    write(tmp_path / "early.csv", "bp7,early\n")
    files = [f"file://{tmp_path}/early.csv", f"file://{c}"]
    assert dict(map(tuple, ontology.read_abbreviations(spark, files).collect()))["bp7"] == "later"
    assert dict(map(tuple, ontology.read_abbreviations(spark, files[::-1]).collect()))["bp7"] == "early"

    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for force in (False, False, True):
        assert ontology.cached_table(spark, str(tmp_path / "cache"), build, force).count() == 3
    assert len(calls) == 2


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return buf.getvalue()


def test_report_files_and_sync(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "ANA_LOPEZ_03-05-2021_DR_Noir.docx").write_bytes(docx(["La patiente Ana Lopez, âgée de 7 ans", "  ", "Diagnostic principal : asthme"]))
    (d / "~$lock.docx").write_bytes(b"x")
    (d / "bad.docx").write_bytes(b"not a zip")
    (d / "n.txt").write_bytes(b"caf\xe9 long text")
    files = report_files.read_reports(spark, str(d))
    got = {r.filename: r.text for r in files.collect()}
    assert got == {"ANA_LOPEZ_03-05-2021_DR_Noir.docx": "La patiente Ana Lopez, âgée de 7 ans\nDiagnostic principal : asthme", "bad.docx": ""}
    assert report_files.read_reports(spark, str(d), "txt").first().text == "caf� long text"
    rows, counts = R.sync_new(files, spark.createDataFrame([("z",)], "filename string"))
    assert tuple(counts.first()) == (1, 1, 2)
    r = rows.first()
    assert (r.patient_name, r.doctor_name, str(r.report_date), r.char_count) == ("Ana Lopez", "Noir", "2021-05-03", len(r.content_text))
    ok, bad = R.build_dossiers(files)
    assert {x.full_name for x in ok.collect()} == {"Ana Lopez", "Bad"} and bad.count() == 0


def test_sinks_and_saved_outputs(spark, tmp_path):
    run = Pipeline(dims(spark)).run(spark.createDataFrame(NOTES, "note_id string, text string"))
    full = run.full_output()
    rows = sinks.result_rows(run.notes, run.stats, run.summary().drop("total_entities", "matched_hpo"), run.candidates, full)
    for _ in range(2):
        sinks.append_results(rows, str(tmp_path / "results"))
    back = spark.read.parquet(str(tmp_path / "results"))
    assert back.count() == 2 * len(NOTES) and back.where("note_id = 'n1'").first().negated_count == 2
    sinks.write_note_json(run.documents, str(tmp_path / "json"))
    one = spark.read.text(str(tmp_path / "json" / "phenopacket" / "note=n4")).first().value
    assert json.loads(one)["interpretations"] is None
    few = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("note_id"), F.struct("id").alias("phenopacket"))
    sinks.write_note_json(few, str(tmp_path / "dealt"))
    files = [f.name for f in (tmp_path / "dealt" / "phenopacket").glob("note=*/part-*")]
    assert len(files) == 40 and len({f[:10] for f in files}) > 1  # several tasks write the notes of one
    sinks.write_metrics(spark.range(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    (tmp_path / "saved").mkdir()
    for n in ("b", "a"):
        write(tmp_path / "saved" / f"{n}_full_output.json", json.dumps({"note_id": n}))
    assert [r.note_id for r in corpora.saved_outputs(spark, str(tmp_path / "saved"), "note_id string").collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stamp = "2024-01-01T00:00:00Z"
    for i, part in enumerate([NOTES[:2], NOTES[1:]]):
        write(src / f"p{i}.json", "\n".join(json.dumps({"note_id": n, "text": t, "received_at": stamp}) for n, t in part))
    pipe = Pipeline(dims(spark))
    q = run_stream(read_note_stream(spark, str(src), files_per_batch=1), pipe, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = pipe.run(spark.createDataFrame([n for n in NOTES if len(n[1].strip()) >= 50], "note_id string, text string"))
    want = {r.note_id: (r.total, r.matched) for r in batch.stats.collect()}
    assert set(want) == {"n1", "n2", "n3"}
    assert {r.note_id: (r.total_entities, r.matched_hpo) for r in got.collect()} == want and got.count() == len(want) == 3


def test_report_tables(spark):
    d = spark.createDataFrame(
        [("1", "000001", "Ana Lopez", ["a"], None), ("2", None, "Bob Stone", None, None)],
        "id string, dossier_number string, full_name string, tags array<string>, updated_at timestamp",
    )
    batch = spark.createDataFrame(
        [(1, "000001", "Zed"), (2, None, "lopez"), (3, "N9", "New One"), (4, "N9", "New Two"), (5, None, "new three"), (6, None, "New Three")],
        "row_id int, dossier_number string, full_name string",
    )
    inserts, links = R.upsert_dossiers(batch, d)
    link = {r.row_id: r.dossier_id for r in links.collect()}
    assert link[1] == "1" and link[2] == "1" and link[3] == link[4] and link[5] == link[6] != link[3]
    assert sorted(r.full_name for r in inserts.collect()) == ["New One", "new three"]
    ok, bad = R.split_unique(batch, d)
    assert sorted(r.row_id for r in ok.collect()) == [2, 3, 5, 6] and sorted(r.row_id for r in bad.collect()) == [1, 4]
    stored = spark.createDataFrame([("f1", None), ("f2", "9")], "filename string, dossier_id string")
    inc = spark.createDataFrame([("f1", "1"), ("f3", "2")], "filename string, dossier_id string")
    assert {r.filename: r.dossier_id for r in R.upsert_reports(stored, inc).collect()} == {"f1": "1", "f2": "9", "f3": "2"}
    tags = spark.createDataFrame([("1", " New ", "add"), ("1", "a", "remove"), ("2", "x", "add"), ("2", "X", "add")], "id string, tag string, action string")
    assert {r.id: r.tags for r in R.merge_tags(d, tags).collect()} == {"1": ["new"], "2": ["x"]}
    rep = spark.createDataFrame([("2024-03-05",), ("2024-01-31",)], "d string").select(F.to_timestamp("d").alias("created_at"))
    assert [r.value for r in R.monthly_trend(rep, "2024-03-20", 4).collect()] == [0, 1, 0, 1]
