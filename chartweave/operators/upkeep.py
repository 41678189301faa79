"""Closure and information content kept up to date from tables of signed changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators.ontology import ancestor_closure, profile_closure
from chartweave.scale import lookup_join
from chartweave.session import materialise


def apply_signed(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct rows of ``table`` after rows with ``sign`` 1 are added and -1 removed; one that is both stays."""
    rows = changes.select(*table.columns, "sign").where(F.col("sign").isin(-1, 1)).groupBy(*table.columns).agg(F.max("sign").alias("sign"))
    plus, minus = rows.where("sign = 1").select(table.columns), rows.where("sign = -1").select(table.columns)
    return lookup_join(table, minus, table.columns, "left_anti").unionByName(plus).distinct()


def signed_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that came (``sign`` 1) and went (-1) between two tables of distinct rows."""
    came = new.join(old, new.columns, "left_anti").withColumn("sign", F.lit(1))
    return came.unionByName(old.join(new, new.columns, "left_anti").withColumn("sign", F.lit(-1)))


def update_closure(edges: DataFrame, closure: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, closure, signed pairs)`` after changes ``(child, parent, sign)`` to the edges.

    Only terms at or below the child of a changed edge can gain or lose an ancestor.
    Those are closed anew among themselves; where an edge leaves them, the ancestors
    of the term it reaches are read from the old closure. All other pairs stay as
    they are. A term without any edge left has no pair. A change near the root
    affects all terms below it, as it must. Edges with a null end are ignored.
    """
    edges = edges.select("child", "parent")
    changes = materialise(changes.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent", "sign"))
    now = materialise(apply_signed(edges, changes))
    ends = changes.select(F.col("child").alias("ancestor")).distinct()
    below = lookup_join(closure, ends, "ancestor", "left_semi").select("term")
    affected = materialise(below.union(changes.select("child")).union(changes.select("parent")).distinct())
    nodes = now.select(F.col("child").alias("term")).union(now.select("parent")).distinct()

    leaving = lookup_join(now, affected.withColumnRenamed("term", "child"), "child", "left_semi")
    inside = lookup_join(leaving, affected.withColumnRenamed("term", "parent"), "parent", "left_semi")
    exits = lookup_join(leaving, affected.withColumnRenamed("term", "parent"), "parent", "left_anti")
    inner = ancestor_closure(inside, affected.join(nodes, "term", "left_semi"))
    # The terms the exits reach are unaffected, so their old ancestors hold.
    beyond = lookup_join(closure, exits.select(F.col("parent").alias("term"), F.col("child").alias("_from")), "term").select("_from", "ancestor").distinct()
    outer = inner.select("term", F.col("ancestor").alias("_from")).join(beyond, "_from").select("term", "ancestor")
    fresh = materialise(inner.unionByName(outer).distinct())
    before = lookup_join(closure, affected, "term", "left_semi").select("term", "ancestor")
    delta = materialise(signed_difference(before, fresh))
    kept = lookup_join(closure, affected, "term", "left_anti").select("term", "ancestor")
    return now, materialise(kept.unionByName(fresh)), delta


@dataclass(frozen=True)
class Ontology:
    """Edges and disease annotations with what is derived from them.

    ``reach`` holds ``(disease_id, ancestor)``: a profile's terms and all above them;
    ``counts`` the diseases ``n`` of each concept.
    """

    edges: DataFrame
    closure: DataFrame
    annotations: DataFrame
    reach: DataFrame
    counts: DataFrame
    diseases: int

    @classmethod
    def build(cls, edges: DataFrame, annotations: DataFrame) -> Ontology:
        """All of it from the edges and annotations."""
        edges = materialise(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
        annotations = materialise(annotations.select("disease_id", "concept_id").where("disease_id IS NOT NULL AND concept_id IS NOT NULL").distinct())
        closure = ancestor_closure(edges)
        reach = materialise(profile_closure(annotations, closure))
        counts = materialise(reach.groupBy(F.col("ancestor").alias("concept_id")).agg(F.count(F.lit(1)).alias("n")))
        return cls(edges, closure, annotations, reach, counts, annotations.agg(F.count_distinct("disease_id")).first()[0])

    def changed(self, edge_changes: DataFrame, annotation_changes: DataFrame) -> Ontology:
        """The same after signed changes of edges (child, parent, sign) and annotations (disease_id, concept_id, sign).

        A disease is reached anew only if its annotations changed or it is annotated
        with a term whose ancestors did; counts take the signed difference.
        """
        edges, closure, pairs = update_closure(self.edges, self.closure, edge_changes)
        signed = materialise(annotation_changes.where("disease_id IS NOT NULL AND concept_id IS NOT NULL"))
        annotations = materialise(apply_signed(self.annotations, signed))
        terms = pairs.select(F.col("term").alias("concept_id")).distinct()
        touched = materialise(
            lookup_join(annotations, terms, "concept_id", "left_semi").select("disease_id").union(signed.select("disease_id")).distinct()
        )
        again = materialise(profile_closure(lookup_join(annotations, touched, "disease_id", "left_semi"), closure))
        before = lookup_join(self.reach, touched, "disease_id", "left_semi")
        steps = signed_difference(before.select("disease_id", "ancestor"), again).groupBy(F.col("ancestor").alias("concept_id")).agg(F.sum("sign").alias("_step"))
        counts = self.counts.join(steps, "concept_id", "full").select(
            "concept_id", (F.coalesce("n", F.lit(0)) + F.coalesce("_step", F.lit(0))).alias("n")
        )
        reach = lookup_join(self.reach, touched, "disease_id", "left_anti").unionByName(again)
        diseases = annotations.agg(F.count_distinct("disease_id")).first()[0]
        return Ontology(edges, closure, annotations, materialise(reach), materialise(counts.where("n > 0")), diseases)

    def information_content(self) -> DataFrame:
        """G3 from the counts as they stand."""
        total = F.lit(self.diseases)
        ic = F.when(F.col("n") < total, -F.log2(F.col("n") / total)).otherwise(F.lit(0.0))
        return self.counts.select("concept_id", "n", ic.alias("ic"))
