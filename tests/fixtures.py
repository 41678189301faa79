"""Small invented dimension tables."""

from chartweave import schemas
from chartweave.operators import lexicon as L
from chartweave.operators.normalize import Dictionaries
from chartweave.plans.pipeline import Dimensions

CONCEPTS = [
    ("HP:1", "Fever", "", ["High temperature"], ["Hot skin"], ["UMLS:C01", "X:1"], 1),
    ("HP:2", "Cough", "", ["Dry cough"], [], ["UMLS:C02", "UMLS:C03"], 2),
    ("HP:3", "Rash", "", ["Skin eruption"], ["High temperature"], [], 3),
    ("HP:4", "Joint pain", "", ["Arthralgia"], [], ["UMLS:C02"], 4),
    ("HP:5", "Recurrent infections", "", [], [], [], 5),
    ("HP:0000118", "Abnormality", "", [], [], [], 6),
]
EDGES = [
    ("HP:1", "HP:10"), ("HP:2", "HP:11"), ("HP:3", "HP:12"), ("HP:4", "HP:13"), ("HP:5", "HP:11"),
    ("HP:10", "HP:20"), ("HP:11", "HP:20"), ("HP:12", "HP:20"), ("HP:13", "HP:20"), ("HP:11", "HP:10"),
]
PROFILES = [
    ("ORPHA:1", "Alpha-Beta long syndrome", "HP:1"), ("ORPHA:1", "Alpha-Beta long syndrome", "HP:2"),
    ("ORPHA:2", "Gamma disease name", "HP:3"), ("ORPHA:2", "Gamma disease name", "HP:4"),
    ("ORPHA:3", "Delta", "HP:5"), ("ORPHA:3", "Delta", "HP:2"), ("ORPHA:3", "Delta", "HP:4"),
]


def dims(spark, **extra) -> Dimensions:
    concepts = spark.createDataFrame(CONCEPTS, schemas.CONCEPTS)
    curated = spark.createDataFrame([("tummy ache", "HP:4", "Joint pain")], "term string, concept_id string, name string")
    bilingual = L.bilingual_table(
        spark.createDataFrame(
            [("fièvre", "HP:1", "Fever"), ("rejet", None, None)], "term string, concept_id string, name string"
        ),
        spark.createDataFrame([("toux", "HP:2", "Cough"), ("fièvre", "HP:9", "Other")], "term string, concept_id string, name string"),
    )
    return Dimensions(
        dictionaries=Dictionaries(
            lookup=L.build_lookup(concepts, curated),
            abbreviations=spark.createDataFrame(
                [("jp", "joint pain", "en", 0), ("jp", "jambe pliée", "fr", 0), ("ri", "recurrent infections", None, 0)],
                schemas.ABBREVIATIONS,
            ),
            bilingual=bilingual,
            translations=spark.createDataFrame([("éruption", "skin eruption", 0)], "term string, english string, priority int"),
            blacklist=L.blacklist_table(spark),
            **extra,
        ),
        concepts=concepts,
        edges=spark.createDataFrame(EDGES, schemas.EDGES),
        profiles=spark.createDataFrame(PROFILES, schemas.PROFILES),
    )
