from chartweave.operators.reports import run_summary
from chartweave.plans.evaluation import evaluate
from chartweave.plans.pipeline import Pipeline
from pyspark.sql import functions as F
from tests.fixtures import dims

NOTES = [
    ("n1", "No cough or fever, but rash since Monday. Patient is a 6 yo male. Temp: 101.2 F. Joint pain and recurrent infections."),
    ("n2", "L'enfant a une toux. Pas de fièvre retrouvée ce jour. Le patient est admis à l'hôpital pour la prise en charge."),
    ("n3", "The patient presents with Alpha-Beta long syndrome and cough. Sex: F. Prostate normal, year old denies."),
    ("n4", ""),
]


def test_run_end_to_end(spark):
    notes = spark.createDataFrame(NOTES, "note_id string, text string")
    run = Pipeline(dims(spark)).run(notes)
    ents = {(r.note_id, r.hpo_id): r for r in run.entities.where("matched").collect()}
    assert ents["n1", "HP:2"].negated and ents["n1", "HP:1"].negated
    assert not ents["n1", "HP:3"].negated
    assert not ents["n2", "HP:2"].negated and ents["n2", "HP:1"].negation_cue == "pas de"
    assert ("n1", "HP:5") in ents and ("n1", "HP:4") in ents
    assert {r.note_id: r.language for r in run.notes.collect()} == {"n1": "en", "n2": "fr", "n3": "en", "n4": "fr"}
    nums = run.numeric.collect()
    assert [(n.note_id, n.concept_id, n.value) for n in nums] == [("n1", "HP:0001945", 101.2)]
    cands = run.candidates.where("note_id = 'n3'").orderBy("rank").collect()
    assert cands[0].disease_id == "ORPHA:1" and cands[0].text_match
    docs = {r.note_id: r.phenopacket for r in run.documents.collect()}
    assert len(docs) == 4 and docs["n1"].subject.sex == "MALE"
    assert docs["n1"].subject.timeAtLastEncounter.age.iso8601duration == "P6Y"
    assert docs["n4"].phenotypicFeatures == [] and docs["n4"].interpretations is None
    assert docs["n3"].target == "Alpha-Beta long syndrome"
    assert [w.type for w in docs["n3"]._validationWarnings] == ["sex_anatomy_conflict"]
    full = run.full_output().where("note_id = 'n1'").first()
    assert full.module4.stats.total == full.phenopacket._pipelineStats.totalEntities
    s = run.summary().where("note_id = 'n1'").first()
    assert s.negated_count == 2 and s.numeric_phenotypes == 1

    gold = spark.createDataFrame(
        [("n1", "d", "ORPHA:2", ["HP:3", "HP:4", "HP:77"]), ("n3", "e", "ORPHA:1", ["HP:2"])],
        "note_id string, disease string, disease_id string, expected array<string>",
    )
    ev = evaluate(run, gold, dims(spark).edges)
    rows = {r.note_id: r for r in ev["rows"].collect()}
    assert rows["n1"].tp == 2 and rows["n1"].fn == 1 and rows["n3"].tp == 1
    assert ev["topk"].first().total == 2
    assert ev["score"].first().n_reports == 4
    assert ev["compliance"].first().total == 4
    assert {r.negation_cue: r["count"] for r in ev["cues"].collect()} == {"no": 2, "pas de": 1}
    assert ev["cascade"].count() >= 1
