"""Ontology, annotation and label files to dimension tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave import schemas
from chartweave.functions.text import strip
from chartweave.scale import pick_first

CONCEPT_URI = "http://purl.obolibrary.org/obo/HP_"
EMPTY = "cast(array() as array<string>)"


def _texts(c: str):
    return F.filter(
        F.transform(F.coalesce(F.col(c), F.expr(EMPTY)), lambda s: strip(s)), lambda s: F.length(s) > 0
    )


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of an OWL file: classes of the ontology with an id, without
    obsolete ones. ``ord`` follows the file."""
    rows = (
        spark.read.format("xml").option("rowTag", "owl:Class").option("valueTag", "_text")
        .schema(schemas.OWL_CLASS).load(path)
    )
    return (
        rows.where(F.col("`_rdf:about`").startswith(CONCEPT_URI) & F.col("`oboInOwl:id`").isNotNull())
        .select(
            strip(F.col("`oboInOwl:id`")).alias("id"),
            strip(F.coalesce(F.col("`rdfs:label`"), F.lit(""))).alias("name"),
            strip(F.coalesce(F.col("`obo:IAO_0000115`"), F.lit(""))).alias("definition"),
            _texts("`oboInOwl:hasExactSynonym`").alias("exact_synonyms"),
            _texts("`oboInOwl:hasRelatedSynonym`").alias("related_synonyms"),
            _texts("`oboInOwl:hasDbXref`").alias("xrefs"),
        )
        .where(~F.lower("name").startswith("obsolete"))
        .withColumn("ord", F.monotonically_increasing_id())
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)`` of the first graph of a JSON ontology graph."""
    rows = spark.read.schema(schemas.EDGE_GRAPH).option("multiLine", True).json(path)
    e = rows.select(F.explode(F.get("graphs", F.lit(0))["edges"]).alias("e")).where("e.pred = 'is_a'")
    rewritten = lambda c: F.replace(F.col(c), F.lit(CONCEPT_URI), F.lit("HP:"))
    return e.select(rewritten("e.sub").alias("child"), rewritten("e.obj").alias("parent")).where(
        F.col("child").startswith("HP:") & F.col("parent").startswith("HP:")
    ).distinct()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Long ``(disease_id, name, concept_id)`` of an annotation TSV; negated and
    foreign rows are dropped and a disease's first name is used."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("comment", "#").schema(
        "database_id string, disease_name string, qualifier string, concept_id string"
    ).option("mode", "PERMISSIVE").csv(path)
    kept = rows.select(
        F.trim("database_id").alias("disease_id"), F.trim("disease_name").alias("name"),
        F.upper(F.trim(F.coalesce("qualifier", F.lit("")))).alias("q"), F.trim("concept_id").alias("concept_id"),
        F.monotonically_increasing_id().alias("_line"),
    ).where(
        F.col("disease_id").startswith("ORPHA:") & (F.col("q") != "NOT") & F.col("concept_id").startswith("HP:")
    )
    names = pick_first(kept, ["disease_id"], [F.col("_line")], ["name"])
    return kept.select("disease_id", "concept_id").distinct().join(names, "disease_id").select(
        "disease_id", "name", "concept_id"
    )


def annotation_stats(profiles: DataFrame) -> DataFrame:
    """Diseases and average, least and most concepts per disease."""
    sizes = profiles.groupBy("disease_id").agg(F.count_distinct("concept_id").alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("diseases"), F.round(F.avg("n"), 1).alias("avg_terms"),
        F.min("n").alias("min_terms"), F.max("n").alias("max_terms"),
    )


def read_french_labels(spark: SparkSession, labels: str, synonyms: str | None = None) -> DataFrame:
    """``(term, concept_id, name)``: of equal labels the last wins, synonyms
    only fill terms without a label."""

    def rows(path: str, priority: int) -> DataFrame:
        raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
        cols = raw.columns
        return raw.select(
            F.trim(F.col(f"`{cols[0]}`")).alias("concept_id"), F.trim(F.col(f"`{cols[5]}`")).alias("name"),
            F.lower(F.trim(F.col(f"`{cols[7]}`"))).alias("term"), F.lit(priority).alias("_p"),
            (F.monotonically_increasing_id() * (-1 if priority == 0 else 1)).alias("_line"),
        ).where(F.col("concept_id").startswith("HP:") & (F.length("term") > 0) & ((F.length("name") > 0) | F.lit(priority == 1)))

    both = rows(labels, 0)
    if synonyms:
        both = both.unionByName(rows(synonyms, 1))
    return pick_first(both, ["term"], [F.col("_p"), F.col("_line")], ["concept_id", "name"])


def read_abbreviations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(key, expansion)`` of CSV files or folders; of equal keys the last path wins.

    Each path is a scan that carries its place in the list: the same file has several
    spellings (``file:/``, ``file:///``), so names are not compared. In a folder the
    last file by name wins, in a file the last line.
    """

    def rows(place: int, path: str) -> DataFrame:
        meta = F.col("_metadata")
        order = F.struct(
            F.lit(place).alias("p"), meta["file_path"].alias("f"), meta["file_block_start"].alias("b"),
            F.monotonically_increasing_id().alias("l"),
        )
        return spark.read.schema("key string, expansion string").csv(path).select(
            F.lower(F.trim("key")).alias("key"), F.trim("expansion").alias("expansion"), order.alias("_o")
        )

    both = reduce(DataFrame.unionByName, [rows(i, p) for i, p in enumerate(paths)])
    clean = both.where(F.length("key").between(2, 10) & (F.length("expansion") > 0))
    return clean.groupBy("key").agg(F.max_by("expansion", "_o").alias("expansion"))


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """K3: the Parquet table at ``path``, built once unless ``force``."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
