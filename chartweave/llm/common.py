"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.session import materialise

#: Characters of ``[\x20\x09-\x0D]``, as a trim list and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; plain ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tie a derived row to its document: the id and a hash of the text.

    Rows that share both are the same document as far as a verdict goes.
    """
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the columns of :func:`row_key`."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def keep_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: ``stay`` has (doc_id, text_key, rows, stay), the rows there are and how many of them stay.

    Documents are matched by id and text. Only where rows repeat both and some of
    them go, the repeats are ranked and as many stay as said.
    """
    stay = materialise(stay)
    # The row travels as one struct, so that no column of it can clash with the keys.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    out = marked.join(stay.where("stay = rows"), same_row(marked, stay), "left_semi").select("row.*")
    part = stay.where("stay > 0 and stay < rows")
    if part.isEmpty():
        return out
    own = Window.partitionBy(marked["doc_id"], marked["text_key"]).orderBy("row")
    ranked = marked.join(part, same_row(marked, part)).withColumn("n", F.row_number().over(own))
    return out.unionByName(ranked.where("n <= stay").select("row.*"))


def small_batches(spark, rows: int = 500) -> None:
    """Bound what a Python worker gets at once; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def filter_texts(docs: DataFrame, test: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows whose text passes, with all their columns, where they lie.

    ``test`` is called once in a task and returns the test of one text.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def share(spark, thing) -> Callable[[], object]:
    """Broadcast an object of this package; call the result once in a task to read it.

    It travels by value like the functions that use it. Callers bound its size.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def let_go(spark) -> None:
    """Have finished stages' shuffle files deleted.

    Spark deletes them when the driver's garbage collector meets their plans, which
    may be long after a stage was written; steps that shuffle whole texts ask for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
