"""Note corpora, gold tables and saved results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave import schemas


def _read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON array files, read one to a task, or JSON ``lines``, which are split; a
    missing path gives an empty table of the same schema."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def labelled_corpus(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(notes, gold)`` of annotated notes in a JSON array, or JSON ``lines``."""
    rows = spark.read.schema(schemas.LABELLED_CORPUS).option("multiLine", not lines).json(path)
    notes = rows.select("note_id", "text", F.col("source_file").alias("filename"))
    gold = rows.select(
        "note_id", "disease", F.col("orpha_id").alias("disease_id"), F.col("expected_hpo").alias("expected"),
        F.col("source_file").alias("filename"),
    )
    return notes, gold


def case_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Unlabelled case reports; a missing file is an empty corpus."""
    return _read_json(spark, path, schemas.CASES, lines)


def saved_outputs(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*_full_output.json", lines: bool = False
) -> DataFrame:
    """Saved result documents with their file name, in name order."""
    rows = spark.read.schema(schema).option("multiLine", not lines).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("file_name", F.col("_metadata.file_name")).orderBy("file_name")


def _expected_ids(raw: Column) -> Column:
    """List of ids, object keyed by id or list of objects, given as JSON text."""
    as_list = F.from_json(raw, "array<string>")
    as_objects = F.from_json(raw, "array<struct<hpo_id:string>>")
    as_map = F.map_keys(F.from_json(raw, "map<string,string>"))
    object_ids = F.filter(F.transform(as_objects, lambda o: o["hpo_id"]), lambda i: i.isNotNull())
    return (
        F.when(raw.rlike(r"^\s*\{"), as_map)
        .when(raw.rlike(r"^\s*\[\s*\{"), object_ids)
        .otherwise(as_list)
    )


def gold_table(raw: DataFrame, notes: DataFrame | None = None, keyed_by: str = "note_id") -> DataFrame:
    """Gold rows of any keying as ``(note_id, disease, disease_id, expected)``.

    ``raw`` has ``note_id`` or ``disease``, ``disease_id`` (or ``orpha_id``) and
    ``expected_hpo`` as JSON text in one of its three forms. Disease-keyed gold
    takes its note ids from ``notes (note_id, disease)``.
    """
    ident = "disease_id" if "disease_id" in raw.columns else "orpha_id"
    rows = raw.withColumn("expected", F.coalesce(_expected_ids(F.col("expected_hpo")), F.expr("array()"))).withColumn(
        "disease_id", F.col(ident)
    )
    if keyed_by == "disease":
        rows = notes.select("note_id", "disease").join(rows.select("disease", "disease_id", "expected"), "disease")
    elif notes is not None:
        rows = rows.join(notes.select("note_id"), "note_id", "left_semi")
    return rows.select("note_id", "disease", "disease_id", "expected")
