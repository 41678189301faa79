"""Notes that Spark derives from the driver tables.

The driver's texts hold no clinical phrases, so the queries that need them write
one note per order or customer whose phrases carry that row's values. Oracles then
compute the expected findings from the columns, without reading any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.plans.registry import Tables
from chartweave.scale import spread

DRUGS = {"1-URGENT": "warfarin", "2-HIGH": "metformin", "3-MEDIUM": "ibuprofen", "4-NOT SPECIFIED": "aspirin", "5-LOW": "vitamin c"}
CONDITIONS = {"F": "hemophilia", "O": "renal failure", "P": "peptic ulcer"}


def _pick(c, table: dict[str, str]):
    out = F.lit("none")
    for k, v in table.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def visits(t: Tables) -> DataFrame:
    """One English note per order."""
    day = F.col("o_orderdate").cast("date")
    o = spread(t.orders).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", day.alias("day"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = (
        o.withColumn("dob", F.date_sub("day", (cust % 9000).cast("int")))
        .withColumn("event", F.trunc(F.add_months("dob", (key % 49 - 24).cast("int")), "month"))
        .withColumn("age", (key % 26).cast("int"))
        .withColumn("sex", F.when(cust % 2 == 0, "male").otherwise("female"))
        .withColumn("temp", F.format_number(F.lit(36.0) + (key % 50) / 10, 1))
        .withColumn("glucose", (F.lit(40) + cust % 200).cast("int"))
        .withColumn("a1c", (F.lit(5) + key % 6).cast("int"))
        .withColumn("wbc", (F.lit(4) + cust % 15).cast("int"))
        .withColumn("plt", (F.lit(90) + key % 200).cast("int"))
        .withColumn("drug", _pick("o_orderpriority", DRUGS))
        .withColumn("condition", _pick("o_orderstatus", CONDITIONS))
        .withColumn("organ", F.when(key % 3 == 0, "ovarian cyst").when(key % 3 == 1, "enlarged prostate").otherwise("sore knee"))
    )
    text = F.format_string(
        "DOB: %s. Visit Date: %s. A %d year old %s seen for %s. Had surgery in %s. "
        "Temp: %s C. Glucose: %d mg/dL. HbA1c: %d%%. WBC: %d K/uL. Plt: %d K. Takes %s for pain. Known %s.",
        F.date_format("dob", "dd/MM/yyyy"), F.date_format("day", "yyyy-MM-dd"), "age", "sex", "organ",
        F.date_format("event", "MMMM yyyy"), "temp", "glucose", "a1c", "wbc", "plt", "drug", "condition",
    )
    return rows.withColumn("text", text).withColumnRenamed("o_orderkey", "note_id")


#: The same columns in SQL.
VISITS_SQL = """
visits AS (
  SELECT o_orderkey AS note_id, o_custkey, CAST(o_orderdate AS DATE) AS day,
         CAST(o_orderdate AS DATE) - CAST(o_custkey % 9000 AS INTEGER) AS dob,
         CAST(date_trunc('month', CAST(o_orderdate AS DATE) - CAST(o_custkey % 9000 AS INTEGER)
              + to_months(CAST(o_orderkey % 49 - 24 AS INTEGER))) AS DATE) AS event,
         o_orderkey % 26 AS age,
         CASE WHEN o_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
         round(36.0 + (o_orderkey % 50) / 10.0, 1) AS temp,
         40 + o_custkey % 200 AS glucose, 5 + o_orderkey % 6 AS a1c, 4 + o_custkey % 15 AS wbc,
         90 + o_orderkey % 200 AS plt, o_orderpriority, o_orderstatus, o_orderkey
  FROM orders)
"""


def letters(c: Column) -> Column:
    """A key as letters, usable in a name."""
    return F.translate(F.lpad(c.cast("string"), 6, "0"), "0123456789", "abcdefghij")


def charts(t: Tables) -> DataFrame:
    """One French report per customer, with a file name."""
    key = F.col("c_custkey")
    c = spread(t.customer).select("c_custkey", "c_nationkey", "c_mktsegment").withColumn("n", (key % 17 + 1).cast("int"))
    name = F.initcap(letters(key))
    girl = key % 2 == 1
    unit = F.when(key % 3 == 0, "mois").otherwise("ans")
    diagnosis = F.lower("c_mktsegment")
    text = F.concat(
        F.when(girl, "La patiente ").otherwise("Le patient "), name, F.lit(" Zed, "),
        F.when(girl, "âgée de ").otherwise("âgé de "), F.col("n").cast("string"), F.lit(" "), unit,
        F.lit(", originaire et demeurant à ville "), F.initcap(letters(F.col("c_nationkey"))), F.lit(", suivi.\n"),
        F.lit("Père : "), (F.col("n") + 25).cast("string"), F.lit(" ans, sain\n"),
        F.lit("Consanguinité du 2eme degré\n"),
        F.lit("Diagnostic principal : "), diagnosis, F.lit("\n"),
        F.lit("Diagnostics associés : "), F.when(key % 4 == 0, "aucun").otherwise("asthme"), F.lit("\n"),
        F.lit("Date de diagnostic : "), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("/03/2019\n"),
        F.lit("Dossier N° : "), F.lpad((key % 1000000).cast("string"), 6, "0"), F.lit("\n"),
        F.when(key % 5 == 0, F.lit("Dr Martin\n")).otherwise(F.lit("")),
    )
    filename = F.concat(
        F.upper(letters(key)), F.lit("_ZED_"), F.when(key % 2 == 0, "SCID_").otherwise(""),
        F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("-05-2021_DR_Durand.docx"),
    )
    return c.select("c_custkey", "c_nationkey", "c_mktsegment", "n", text.alias("text"), filename.alias("filename"))
