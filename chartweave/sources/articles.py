"""Article XML to case reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartweave.functions.text import count_tokens, strip
from chartweave.scale import lookup_join, top_k
from chartweave.session import materialise

ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<"
    "ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>>"
)


def read_articles(spark: SparkSession, path: str, min_chars: int = 200) -> DataFrame:
    """S3: ``(pmid, title, abstract, journal, year, authors, word_count, text)``.

    Splittable row-tag scan of files on disk; labelled abstract parts are joined by
    line breaks, the year falls back to the free-form date, three authors are kept.
    """
    rows = (
        spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_")
        .schema(ARTICLE).load(path)
    )
    a = "MedlineCitation.Article"
    part = F.transform(
        f"{a}.Abstract.AbstractText",
        lambda p: F.concat(
            F.when(F.length(p["_Label"]) > 0, F.concat(p["_Label"], F.lit(": "))).otherwise(F.lit("")),
            strip(F.coalesce(p["_VALUE"], F.lit(""))),
        ),
    )
    date = f"{a}.Journal.JournalIssue.PubDate"
    names = F.transform(
        F.filter(F.coalesce(f"{a}.AuthorList.Author", F.expr("array()")), lambda x: F.length(x["LastName"]) > 0),
        lambda x: strip(F.concat_ws(" ", x["LastName"], x["ForeName"])),
    )
    out = rows.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"),
        F.coalesce(f"{a}.ArticleTitle", F.lit("")).alias("title"),
        F.array_join(part, "\n").alias("abstract"),
        F.coalesce(f"{a}.Journal.Title", F.lit("")).alias("journal"),
        F.coalesce(F.nullif(F.col(f"{date}.Year"), F.lit("")), F.substring(f"{date}.MedlineDate", 1, 4), F.lit("")).alias("year"),
        F.slice(names, 1, 3).alias("authors"),
    )
    return out.where(F.length("abstract") > min_chars).withColumn("word_count", count_tokens(F.col("abstract"))).withColumn(
        "text", F.concat(F.lit("Case Report: "), "title", F.lit("\n\n"), "abstract")
    )


def longest_per_group(cases: DataFrame, group: str = "disease", k: int = 3, size: str = "word_count", tie: str = "pmid") -> DataFrame:
    """The ``k`` longest cases per group, with their rank."""
    return top_k(cases, [group], [F.col(size).desc(), F.col(tie)], k)


def number_cases(cases: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Sequential note ids in the given order.

    Range-partitions by the order columns, counts per partition and adds offsets,
    so no task ever sorts or numbers the whole table.
    """
    ranged = cases.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_part", F.spark_partition_id()
    )
    ranged = materialise(ranged)
    w = Window.partitionBy("_part").orderBy(*order)
    per_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(per_part), F.lit(0)).alias("_offset")
    )
    numbered = lookup_join(ranged, offsets, "_part").withColumn("_n", F.col("_offset") + F.row_number().over(w))
    return numbered.withColumn("note_id", F.format_string(prefix + "%03d", "_n")).drop("_part", "_offset", "_n")
