"""Notes with gold annotations to metric tables in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import metrics as M
from chartweave.operators.ontology import bounded_ancestors
from chartweave.plans.pipeline import Result


def evaluate(
    result: Result, gold: DataFrame, edges: DataFrame, groups: DataFrame | None = None
) -> dict[str, DataFrame]:
    """M1 - M9, M11, M13 for one run. ``gold (note_id, disease, disease_id, expected)``."""
    extracted = M.extracted_concepts(result.entities, result.numeric)
    known = extracted.join(gold.select("note_id"), "note_id", "left_semi")
    expected = gold.select("note_id", F.explode("expected").alias("concept_id"))
    near = bounded_ancestors(edges)
    table = M.equivalents(groups) if groups is not None else None
    matches = M.semantic_matches(known, expected, table, near)
    rows = M.note_prf(gold.select("note_id", "disease").join(matches, "note_id", "left").na.fill(0))
    scores = M.score_notes(result.documents, result.notes, result.entities)
    return {
        "rows": rows,
        "prf": M.corpus_prf(rows),
        "by_disease": M.disease_prf(rows),
        "topk": M.topk_accuracy(result.candidates, gold),
        "cascade": M.cascade_distribution(result.entities),
        "detection": M.detection_stats(result.notes, result.entities),
        "cues": M.top_cues(result.entities),
        "compliance": M.compliance(result.documents),
        "score": M.score_summary(scores),
    }
