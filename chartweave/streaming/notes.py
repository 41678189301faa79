"""Notes as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartweave import fixed_values as V
from chartweave.functions.text import strip
from chartweave.plans.pipeline import Pipeline
from chartweave.sources.sinks import result_rows

NOTE_STREAM = "note_id string, text string, received_at timestamp"


def read_note_stream(spark: SparkSession, folder: str, schema: str = NOTE_STREAM, files_per_batch: int = 100) -> DataFrame:
    """JSON note files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def accept(notes: DataFrame, delay: str = "1 day", when: str = "received_at", min_chars: int = V.STREAM_MIN_CHARS) -> DataFrame:
    """Drop short notes and replays of a note id within the watermark."""
    return notes.where(F.length(strip(F.col("text"))) >= min_chars).withWatermark(when, delay).dropDuplicatesWithinWatermark(
        ["note_id"]
    )


def run_stream(
    notes: DataFrame, pipeline: Pipeline, table: str, checkpoint: str, delay: str = "1 day", once: bool = False
) -> StreamingQuery:
    """Score arriving notes and write result rows to a Parquet table.

    Ranking, dedup and greedy steps need windows, so every micro-batch is run as a
    batch. Each batch writes its own ``batch_id`` partition in overwrite mode:
    a batch replayed after a failure replaces its rows instead of doubling them.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        run = pipeline.run(batch.select("note_id", "text"))
        rows = result_rows(run.notes, run.stats, run.summary().drop("total_entities", "matched_hpo"), run.candidates, run.full_output())
        rows.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = (
        accept(notes, delay).writeStream.foreachBatch(process).outputMode("append").option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
