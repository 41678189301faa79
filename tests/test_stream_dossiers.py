"""The keyed dossier stream against a brute-force reading of everything that arrived."""

from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from chartweave.streaming.dossiers import current_reports, follow_dossiers, upserted_dossiers

NOTES = "note_id string, dossier_number string, text string, at string"
SCORED = "dossier_number string, shard int, note_id string, at_ms long, digest string, n long"


def score(rows):
    return rows.select("dossier_number", "shard", "note_id", "at_ms", "digest", F.length("text").cast("long").alias("n"))


def arrive(spark, rows, tmp, delay="2 hours"):
    """One run of the stream over one more arrival; the rows of the table before and after."""
    table = spark.createDataFrame(rows, NOTES).withColumn("received_at", F.to_timestamp("at")).drop("at")
    table.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    src = spark.readStream.schema(table.schema).parquet(f"{tmp}/in")
    follow_dossiers(src, score, f"{tmp}/out", f"{tmp}/state", delay, shards=3, once=True).awaitTermination()
    return spark.read.schema(SCORED).parquet(f"{tmp}/out")


def brute(rows):
    newest = {}
    for note, number, text, at in rows:
        key, version = (number or "", note or ""), (at, sha256((text or "").encode()).hexdigest(), len(text or ""))
        newest[key] = max(newest.get(key, version), version)
    return Counter((*k, v[1], v[2]) for k, v in newest.items())


def test_out_of_order_and_replayed_revisions(spark, tmp_path):
    day = "2024-01-01 "
    first = [
        ("a", "D1", "first text", day + "10:00:00"), ("a", "D1", "older, longer text", day + "09:30:00"), ("b", "D1", "bb", day + "10:05:00"),
        (None, None, None, day + "10:00:00"), ("", None, "", day + "10:00:00"), ("a", "D2", "same id elsewhere", day + "10:00:00"),
    ] + [(f"h{n}", "HOT", "x" * n, day + "10:10:00") for n in range(60)]
    out = arrive(spark, first, tmp_path)
    seen = out.count()
    assert seen == 60 + 4

    second = [
        first[0], first[2], ("b", "D1", "older b", day + "09:00:00"), ("a", "D1", "newer a", day + "10:30:00"), ("c", "D1", "tie one", day + "10:00:00"),
        ("c", "D1", "tie two", day + "10:00:00"),
    ] + first[6:]
    out = arrive(spark, second, tmp_path)
    assert out.count() == seen + 2  # the newer revision and the new report; nothing replayed
    got = current_reports(out)
    assert Counter((r.dossier_number, r.note_id, r.digest, r.n) for r in got.collect()) == brute(first + second)
    totals = {r.dossier_number: (r.n_reports, r.first_report, r.n) for r in upserted_dossiers(got, ["n"]).collect()}
    assert totals["HOT"] == (60, "h0", sum(range(60))) and totals["D1"] == (3, "c", len("newer a") + 2 + len("tie one"))


def test_state_ends_with_the_watermark(spark, tmp_path):
    early, late = ("a", "D1", "text", "2024-01-01 10:00:00"), ("z", "D1", "far ahead", "2024-01-03 10:00:00")
    arrive(spark, [early], tmp_path)
    arrive(spark, [late], tmp_path)
    rows = arrive(spark, [early, ("b", "D1", "too late", "2024-01-02 10:00:00"), ("c", "D1", "in time", "2024-01-03 09:00:00")], tmp_path)
    assert sorted(r.note_id for r in rows.collect()) == ["a", "c", "z"]
    # What the timers removed is gone from the state itself.
    held = (
        spark.read.format("statestore").option("stateVarName", "seen").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state")
    )
    assert {r.user_map_key.note_id for r in held.select("user_map_key").collect()} == {"c", "z"}
    # A newer revision of a report that left the state is a change like any other.
    again = arrive(spark, [("a", "D1", "new text", "2024-01-03 11:00:00"), (None, None, None, None)], tmp_path)
    assert {r.note_id: r.n for r in current_reports(again).collect()}["a"] == len("new text")


def test_document_stream_reads_a_table_of_one_file_and_of_several(spark, tmp_path):
    from chartweave.plans import report_queries  # noqa: F401  (registers the query)
    from chartweave.plans.registry import REGISTRY

    docs = spark.createDataFrame([(i, "x" * 60 + f" a{i}@b.org") for i in range(9)], "doc_id long, text string")
    (tmp_path / "one").mkdir()
    docs.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    for kind in ("one", "many"):
        got = REGISTRY["stream_redaction"][0](spark, f"{tmp_path}/{kind}").collect()
        assert sorted(tuple(r) for r in got) == [(i, 1) for i in range(9)]
