"""Repeated any-column search over trigram posting lists (R2)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.functions.text import let
from chartweave.scale import literal_table, lookup_join
from chartweave.session import materialise

#: Posting lists lie in this many partitions; a search opens those of its grams alone.
BUCKETS = 64
#: A posting list is written by up to this many tasks, so that a gram of every row has no task of its own.
SALTS = 8
#: Posting lists read per searched text, the shortest first; whatever they leave is verified.
LISTS = 4


def text_grams(text: Column) -> Column:
    """Distinct three-character strings of a whole lower-cased text."""
    def grams(chars: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(chars) - 2)
        return F.when(
            F.size(chars) >= 3,
            F.transform(at, lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1), F.element_at(chars, i + 2))),
        )

    def of(low: Column) -> Column:
        # A pattern goes on by UTF-16 units: texts with pairs of them are cut into characters.
        swift = F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1))
        return F.array_distinct(F.when(low.rlike(r"[\x{10000}-\x{10FFFF}]"), let(F.split(low, ""), grams)).otherwise(swift))

    return let(F.lower(text), of)


def query_grams(query: str) -> list[str]:
    """Strings that every text matching a pattern must hold.

    Wildcards end a stretch, and so do characters whose lower case depends on what
    stands beside them or is no single character.
    """
    whole = "".join(c.lower() if len(c.lower()) == 1 and c.lower() not in "σς" and ord(c) < 0x10000 else "%" for c in query)
    stretches = re.split(r"[%_]|\\.?", whole)
    return sorted({s[n : n + 3] for s in stretches for n in range(len(s) - 2)})


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


@dataclass(frozen=True)
class SearchIndex:
    """Posting lists ``(gram, key, bucket)``, their lengths, and the searched columns, in ``folder``."""

    spark: SparkSession
    folder: str
    key: str
    columns: tuple[str, ...]

    @classmethod
    def build(cls, table: DataFrame, folder: str, key: str = "id", columns: Sequence[str] = ("text",)) -> SearchIndex:
        """Write the index of ``table``: one pass over the texts, one shuffle of distinct (gram, key).

        A repeated key stands for all its rows; rows without a key are not indexed.
        """
        rows = table.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *columns)
        rows.write.mode("overwrite").parquet(f"{folder}/texts")
        none = F.array().cast("array<string>")
        grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(text_grams(F.col(c).cast("string")), none) for c in columns])))
        postings = rows.select("_key", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        (
            postings.repartition("bucket", F.pmod(F.xxhash64("_key"), F.lit(SALTS))).sortWithinPartitions("bucket", "gram", "_key")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        )
        index = cls(table.sparkSession, folder, key, tuple(columns))
        index._postings().groupBy("bucket", "gram").agg(F.count_distinct("_key").alias("n")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lengths")
        return index

    def _postings(self) -> DataFrame:
        key = self._texts().schema["_key"].dataType.simpleString()
        return self.spark.read.schema(f"_key {key}, gram string, bucket int").parquet(f"{self.folder}/postings")

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/texts")

    def _lengths(self, grams: list[str]) -> dict[str, int]:
        """Lengths of the named posting lists; those of no row are absent."""
        asked = literal_table(self.spark, [(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
        lengths = self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.folder}/lengths")
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
        found = lengths.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)) if grams else lengths.limit(0)
        return {r.gram: r.n for r in found.select("gram", "n").collect()}

    def search(self, queries: Sequence[str]) -> DataFrame:
        """``(query, key)`` of every row with a query in any column, for several queries at once.

        Equal to a scan with ``ilike('%query%')``: the shortest posting lists of a
        query are intersected, and the rows left are verified. A query without three
        fixed characters in a row has no list and scans the texts; an empty one keeps
        all rows. What reaches the driver is one number per gram of the queries.
        """
        queries = list(dict.fromkeys(q.strip() for q in queries))
        grams = {q: query_grams(q) for q in queries}
        lengths = self._lengths(sorted({g for found in grams.values() for g in found}))
        listed = [q for q in queries if grams[q] and all(g in lengths for g in grams[q])]
        chosen = [(q, g) for q in listed for g in sorted(grams[q], key=lambda g: (lengths[g], g))[:LISTS]]
        key = self._texts().schema["_key"].dataType
        out = literal_table(self.spark, [], f"query string, _key {key.simpleString()}")
        if chosen:
            wanted = literal_table(self.spark, chosen, "query string, gram string")
            need = literal_table(self.spark, [(q, min(LISTS, len(grams[q]))) for q in listed], "query string, need int")
            buckets = [r.b for r in wanted.select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
            lists = self._postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(sorted({g for _, g in chosen})))
            met = lookup_join(lists.distinct(), wanted, "gram").groupBy("query", "_key").agg(F.count(F.lit(1)).alias("n"))
            candidates = materialise(lookup_join(met, need, "query").where("n = need").select("query", "_key"))
            rows = lookup_join(self._texts(), candidates, "_key").withColumn("_pattern", F.concat(F.lit("%"), "query", F.lit("%")))
            hit, plain = F.lit(False), ~F.col("query").rlike(r"[%_\\]")
            for c in self.columns:
                whole = F.col(c).cast("string")
                holds = F.when(plain, F.contains(F.lower(whole), F.lower("query"))).otherwise(F.ilike(whole, F.col("_pattern")))
                hit = hit | F.coalesce(holds, F.lit(False))
            out = out.unionByName(rows.where(hit).select("query", "_key"))
        scanned = [q for q in queries if not grams[q]]
        if scanned:
            def holds(q: str) -> Column:
                return F.greatest(*[F.coalesce(F.col(c).cast("string").ilike(f"%{q}%"), F.lit(False)) for c in self.columns], F.lit(not q))

            found = F.explode(F.filter(F.array(*[F.when(holds(q), F.lit(q)) for q in scanned]), lambda q: q.isNotNull()))
            out = out.unionByName(self._texts().select(found.alias("query"), "_key"))
        return out.distinct().withColumnRenamed("_key", self.key)
