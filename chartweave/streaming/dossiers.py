"""Reports of dossiers as a keyed stream with state and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the stateful step emits: a report whenever its newest revision changes.
CHANGED = "dossier_number string, shard int, note_id string, at_ms long, digest string, text string"


class NewestRevision(StatefulProcessor):
    """Per dossier and shard: which revision of each report is the newest so far.

    The state holds a report's time and digest, not its text, and only while an older
    or equal revision could still arrive: a timer per ``step_ms`` of event time removes
    what the watermark has passed, since rows behind the watermark never get here.
    """

    def __init__(self, step_ms: int) -> None:
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "note_id string", "at_ms long, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            newest = batch.sort_values(["at_ms", "digest"]).drop_duplicates("note_id", keep="last")
            keep = []
            for note, at, digest in zip(newest["note_id"], newest["at_ms"], newest["digest"], strict=True):
                known = self.seen.getValue((note,)) if self.seen.containsKey((note,)) else None
                keep.append(known is None or (int(at), digest) > (known[0], known[1]))
                if keep[-1]:
                    self.seen.updateValue((note,), (int(at), digest))
                    due.add(-(-int(at) // self.step_ms) * self.step_ms)
            changed = newest[keep]
            yield pd.DataFrame({
                "dossier_number": key[0], "shard": key[1], "note_id": changed["note_id"], "at_ms": changed["at_ms"],
                "digest": changed["digest"], "text": changed["text"],
            })
        for moment in due - set(self.handle.listTimers()):
            self.handle.registerTimer(moment)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        for note in [note for note, (at, _) in self.seen.iterator() if at <= passed]:
            self.seen.removeKey(note)
        return iter(())


def keyed(notes: DataFrame, shards: int = 16) -> DataFrame:
    """Key columns of a note (note_id, dossier_number, text, received_at) and its place in the order of revisions.

    Reports without a number share one nameless dossier, null ids count as one id. A
    dossier's reports are dealt over ``shards`` by their id, so that a dossier with
    very many reports is kept by several tasks.
    """
    note = F.coalesce(F.col("note_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    return notes.select(
        F.coalesce("dossier_number", F.lit("")).alias("dossier_number"), F.pmod(F.hash(note), F.lit(shards)).alias("shard"),
        note.alias("note_id"), F.unix_millis("received_at").alias("at_ms"), F.sha2(text, 256).alias("digest"), text.alias("text"),
        "received_at",
    )


def changed_reports(notes: DataFrame, delay: str = "1 day", shards: int = 16, step_ms: int = 3_600_000) -> DataFrame:
    """Reports of a stream, each whenever a newer revision of it than any before arrives.

    Replays and older revisions that come late are recognised whatever their order; a
    row further than ``delay`` behind the newest event is dropped. Of revisions with
    one time the greatest digest counts.
    """
    rows = keyed(notes.where(F.col("received_at").isNotNull()).withWatermark("received_at", delay), shards)
    return rows.groupBy("dossier_number", "shard").transformWithStateInPandas(
        NewestRevision(step_ms), CHANGED, "Update", "EventTime"
    )


def follow_dossiers(
    notes: DataFrame, score: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, delay: str = "1 day", shards: int = 16,
    once: bool = False,
) -> StreamingQuery:
    """Score the reports that changed and write their rows to a Parquet table.

    ``score`` maps (dossier_number, shard, note_id, at_ms, digest, text) to scored
    rows that keep all but the text. A micro-batch replaces its own ``batch_id``
    partition, so one replayed after a failure leaves nothing twice;
    :func:`current_reports` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    spark = notes.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        writer = (
            changed_reports(notes, delay, shards).writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def current_reports(rows: DataFrame) -> DataFrame:
    """The newest scored row of every report; the order of batches does not matter."""
    payload = [c for c in rows.columns if c not in ("dossier_number", "note_id", "batch_id")]
    newest = F.max_by(F.struct(*payload), F.struct("at_ms", "digest")).alias("r")
    return rows.groupBy("dossier_number", "note_id").agg(newest).select("dossier_number", "note_id", "r.*")


def upserted_dossiers(reports: DataFrame, totals: list[str]) -> DataFrame:
    """R7 over the stream's table: every dossier once, with its first report, its newest time and sums of score columns."""
    order = F.struct("at_ms", "note_id")
    return reports.groupBy("dossier_number").agg(
        F.count(F.lit(1)).alias("n_reports"), F.min(order)["note_id"].alias("first_report"), F.max("at_ms").alias("newest_ms"),
        *[F.sum(c).alias(c) for c in totals],
    )
