"""Sinks: per-note JSON, result table, metric reports (K1, K2, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave import fixed_values as V

KEEP_NULLS = {"ignoreNullFields": "false"}


def write_note_json(docs: DataFrame, folder: str, payload: str = "phenopacket", key: str = "note_id") -> None:
    """K1: one JSON document per row, partitioned by note, overwriting.

    The cost is in the files, not in the bytes, so notes are dealt to a fixed number of
    tasks: a small table would be written by one, and adaptive execution would merge them.
    Meant for small result sets; :func:`write_documents` is the table form.
    """
    body = F.to_json(F.col(payload), KEEP_NULLS).alias("value")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.select(F.col(key).alias("note"), body).repartition(n, "note").write.mode("overwrite").partitionBy("note").text(
        f"{folder}/{payload}"
    )


def write_documents(docs: DataFrame, folder: str) -> None:
    """K1: nested documents as Parquet."""
    docs.write.mode("overwrite").parquet(folder)


def result_rows(
    notes: DataFrame, stats: DataFrame, summary: DataFrame, candidates: DataFrame, full: DataFrame, key: str = "note_id",
    text_chars: int | None = None,
) -> DataFrame:
    """K2: flat result rows with the nested results as STRUCT columns.

    The source text stays whole unless ``text_chars`` (``fixed_values.RESULT_TEXT_CHARS``) is given.
    """
    top = candidates.where("rank = 1").select(
        key, F.col("name").alias("ordo_top_name"), F.col("score").alias("ordo_top_score")
    )
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return (
        notes.join(stats, key, "left").join(summary, key, "left").join(top, key, "left")
        .join(full.select(key, F.struct("module1", "module3_warnings", "module4").alias("full_result"), "phenopacket"), key, "left")
        .select(
            key, "language", (F.col("clean_text") if text_chars is None else F.substring("clean_text", 1, text_chars)).alias("source_text"),
            F.coalesce("total", F.lit(0)).alias("total_entities"), F.coalesce("matched", F.lit(0)).alias("matched_hpo"),
            zero("negated_count", 0), F.coalesce("numeric_phenotypes", F.lit(0)).alias("numeric_phenotypes_count"),
            "ordo_top_name", zero("ordo_top_score", 0.0), "full_result", "phenopacket",
        )
    )


def append_results(rows: DataFrame, table: str) -> None:
    """K2."""
    rows.write.mode("append").parquet(table)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """K4: an aggregate of a few rows as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(folder)
