"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.llm.common import SPACES, ascii_lower, row_key, same_row
from chartweave.session import durable_folder, materialise

#: Documents in which a line must be found to be dropped everywhere.
MIN_DOCS = 10
#: Batches in which a stated table is fed to the runs.
BATCHES = 4
#: Runs of one level that are compacted into one run of the next.
FANOUT = 2


def line_key(line: Column) -> Column:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> Column:
    """128 bits of a key in two columns, null for the empty key."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def line_hashes(docs: DataFrame, batches: int = 1) -> DataFrame:
    """Per document the hashes of its lines in order, and the batch it is dealt to."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select(
        *row_key(), F.transform(lines, lambda x: _hashes(line_key(x))).alias("hashes")
    ).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int"))


class LineRuns:
    """Sorted runs (a, b, n) of line hashes with the number of documents that hold the line.

    Every run is a table bucketed and sorted by hash, so that runs are joined and
    merged bucket by bucket where they lie. ``settled`` runs hold lines that have
    reached the threshold: a batch is anti-joined with them and adds only the rest.
    ``fanout`` runs of a level are compacted into one run of the next level, and
    lines that reach the threshold there move to a settled run.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "a", "b").sortWithinPartitions("a", "b")
            .write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
            .option("path", f"{durable_folder(self.spark)}/{name}").saveAsTable(name)
        )
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, hashed: DataFrame) -> None:
        """Add one batch of :func:`line_hashes`."""
        own = hashed.select(F.explode(F.array_distinct("hashes")).alias("x")).where("x is not null").groupBy(
            F.col("x.a").alias("a"), F.col("x.b").alias("b")
        ).agg(F.count(F.lit(1)).alias("n"))
        for run in self.settled:
            own = own.join(run, ["a", "b"], "left_anti")
        self.levels[0].append(self._run(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = self._merged(self.levels[level])
        self.settled.append(self._run(merged.where(F.col("n") >= self.min_docs)))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._run(merged.where(F.col("n") < self.min_docs)))
        self.levels[level] = []

    def frequent(self) -> DataFrame:
        """Hashes (a, b) of every line found in at least ``min_docs`` documents so far."""
        found = [run.select("a", "b") for run in self.settled]
        left = [run for level in self.levels for run in level]
        if left:
            merged = self._merged(left)
            for run in self.settled:  # a line settles once; what came before stays in older runs
                merged = merged.join(run, ["a", "b"], "left_anti")
            found.append(merged.where(F.col("n") >= self.min_docs).select("a", "b"))
        return reduce(DataFrame.unionByName, found)


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents.

    Texts are split at \\n; a null or empty text is one empty line. Empty keys are
    never dropped. Each row of ``docs`` counts as one document, however often it
    repeats a line; rows repeating doc_id and text are documents of their own. A
    null doc_id is kept as it is; other columns are ignored; an empty table gives an
    empty result. Returns doc_id, n_lines, n_dropped, kept (the text that stays).
    """
    spark = docs.sparkSession
    hashed = materialise(line_hashes(docs, batches))
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(hashed.where(F.col("batch") == batch))
    frequent = materialise(runs.frequent())

    at = hashed.dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.posexplode("hashes").alias("at", "x")
    ).where("x is not null").select("doc_id", "text_key", "at", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    dropped = at.join(frequent, ["a", "b"], "left_semi").groupBy("doc_id", "text_key").agg(
        F.collect_list("at").alias("dropped")
    )
    lines = docs.select(*row_key(), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    joined = lines.join(dropped, same_row(lines, dropped), "left").select(
        lines["doc_id"], "lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.size("dropped") == 0, F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    )
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
