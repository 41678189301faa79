"""Report and dossier tables: search, upsert, dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave import fixed_values as V
from chartweave.functions.text import strip
from chartweave.operators.attributes import dossier_attributes, filename_attributes, resolve_attributes
from chartweave.operators.containment import contained
from chartweave.scale import lookup_join, pick_first


# ------------------------------------------------------------------ reading
def newest_first(table: DataFrame, when: str = "created_at", tie: str = "id") -> DataFrame:
    """R1."""
    return table.orderBy(F.col(when).desc(), F.col(tie))


def search(table: DataFrame, query: str, columns: Sequence[str] = V.REPORT_SEARCH) -> DataFrame:
    """R2: rows with the query in any of the columns, ignoring case; an empty
    query keeps all. A pure filter: order the result with :func:`newest_first`."""
    q = query.strip()
    if not q:
        return table
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return table.where(cond)


def filter_facets(
    table: DataFrame, equal: dict[str, str | None], date_from: str | None = None, date_to: str | None = None,
    when: str = "created_at",
) -> DataFrame:
    """Conjunction of equalities and a date range, both days inclusive."""
    for c, v in equal.items():
        if v:
            table = table.where(F.col(c) == v)
    if date_from:
        table = table.where(F.col(when) >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        table = table.where(F.col(when) <= F.to_timestamp(F.lit(f"{date_to} 23:59:59")))
    return table


def facet_values(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(facet, value)``: distinct non-empty values, sorted; one scan."""
    long = table.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "facet", "value")
    return long.where(F.length("value") > 0).distinct().orderBy("facet", "value")


def nest_children(
    parents: DataFrame, children: dict[str, DataFrame], link: str = "dossier_id", when: str = "created_at"
) -> DataFrame:
    """Every parent with its children as arrays, newest first.

    The nested array is the result itself; children are grouped by their parent.
    """
    out = parents
    for name, table in children.items():
        payload = [c for c in table.columns if c != link]
        nested = F.sort_array(F.collect_list(F.struct(when, *[c for c in payload if c != when])), asc=False)
        grouped = table.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("id")).agg(nested.alias(name))
        out = out.join(grouped, "id", "left").withColumn(name, F.coalesce(name, F.expr("array()")))
    return out


# ------------------------------------------------------------------- ingest
def report_rows(files: DataFrame, dossier: str | None = None, content_chars: int | None = None) -> DataFrame:
    """Report columns of ingested ``(filename, text, file_size_bytes)`` rows.

    Texts stay whole unless ``content_chars`` (``fixed_values.CONTENT_CHARS``) is given.
    """
    meta = filename_attributes(F.col("filename"))
    rows = files.withColumn("_m", meta)
    return rows.select(
        "filename",
        F.col("_m.patient_name").alias("patient_name"),
        F.col("_m.doctor_name").alias("doctor_name"),
        F.col("_m.pathology").alias("pathology"),
        F.col("_m.report_date").alias("report_date"),
        "file_size_bytes",
        F.length("text").alias("char_count"),
        (F.col("text") if content_chars is None else F.substring("text", 1, content_chars)).alias("content_text"),
        (F.col(dossier) if dossier else F.lit(None).cast("string")).alias("dossier_id"),
    )


def sync_new(files: DataFrame, stored: DataFrame, min_chars: int = V.SYNC_MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, counts)``. New file names with enough text are synced."""
    known = stored.select("filename", F.lit(True).alias("_known")).distinct()
    marked = files.join(known, "filename", "left").withColumn(
        "_new", F.col("_known").isNull() & (F.length("text") >= min_chars)
    )
    counts = marked.agg(
        F.count_if("_new").alias("synced"), F.count_if(~F.col("_new")).alias("skipped"), F.count(F.lit(1)).alias("total")
    )
    return report_rows(marked.where("_new")), counts


def link_reports(files: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Report rows for files tied to a dossier; metadata missing from the file
    name falls back to the dossier's values."""
    rows = report_rows(files, "dossier_id")
    back = dossiers.select(
        F.col("id").alias("dossier_id"), F.col("full_name").alias("_n"), F.col("treating_doctor").alias("_d"),
        F.col("principal_diagnosis").alias("_p"),
    )
    joined = rows.join(back, "dossier_id", "left")
    return joined.select(
        *[
            F.coalesce(c, {"patient_name": "_n", "doctor_name": "_d", "pathology": "_p"}[c]).alias(c)
            if c in ("patient_name", "doctor_name", "pathology")
            else F.col(c)
            for c in rows.columns
        ]
    )


def build_dossiers(files: DataFrame, form: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(dossiers, rejected)`` from ingested documents."""
    rows = files.withColumn("content", dossier_attributes(F.col("text"))).withColumn(
        "from_name", filename_attributes(F.col("filename"))
    )
    full = resolve_attributes(rows, form).drop("content", "from_name")
    named = F.coalesce(F.length("full_name") > 0, F.lit(False))
    return full.where(named), full.where(~named)


# -------------------------------------------------------------------- upsert
def match_dossiers(batch: DataFrame, dossiers: DataFrame, row_id: str = "row_id") -> DataFrame:
    """R7, matching half: ``(row_id, dossier_id)``.

    By dossier number first; otherwise the first dossier whose name contains the
    row's name, ignoring case: the batch's names make automata of bounded size, which
    every dossier name passes once, so only true matches are ever produced.
    """
    numbered = batch.where(F.length("dossier_number") > 0).select(row_id, "dossier_number")
    by_number = numbered.join(
        dossiers.select("dossier_number", F.col("id").alias("dossier_id")), "dossier_number"
    ).groupBy(row_id).agg(F.min("dossier_id").alias("dossier_id"))
    open_rows = batch.join(by_number.select(row_id), row_id, "left_anti").select(
        row_id, F.lower("full_name").alias("_needle")
    )
    named = dossiers.select(F.col("id").alias("dossier_id"), F.lower("full_name").alias("_name"))
    parts = contained(named, F.col("_name"), ["dossier_id"], open_rows, "_needle").groupBy("_needle").agg(F.min("dossier_id").alias("dossier_id"))
    by_name = open_rows.join(parts, "_needle").select(row_id, "dossier_id")
    return by_number.select(row_id, "dossier_id").unionByName(by_name)


def upsert_dossiers(
    batch: DataFrame, dossiers: DataFrame, row_id: str = "row_id", new_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(dossiers to insert, links)``.

    Rows of the batch that match no stored dossier are grouped by number, else by
    name, and every group is inserted once; ``links`` gives each row its dossier.
    """
    matched = match_dossiers(batch, dossiers, row_id)
    fresh = batch.join(matched.select(row_id), row_id, "left_anti").withColumn(
        "_group",
        F.when(F.length("dossier_number") > 0, F.concat(F.lit("n:"), "dossier_number")).otherwise(
            F.concat(F.lit("p:"), F.lower("full_name"))
        ),
    )
    ident = new_id if new_id is not None else F.sha2(F.col("_group"), 256)
    fresh = fresh.withColumn("id", ident)
    inserts = pick_first(fresh, ["id"], [F.col(row_id)], [c for c in fresh.columns if c not in ("id", "_group")])
    links = matched.select(row_id, F.col("dossier_id").cast("string").alias("dossier_id")).unionByName(
        fresh.select(row_id, F.col("id").cast("string").alias("dossier_id"))
    )
    return inserts, links


def upsert_reports(reports: DataFrame, incoming: DataFrame) -> DataFrame:
    """R7, report half: stored reports get the dossier of an incoming row with the
    same file name; unknown file names are appended."""
    once = pick_first(incoming, ["filename"], [F.col("dossier_id")], [c for c in incoming.columns if c != "filename"])
    links = once.select("filename", F.col("dossier_id").alias("_new"))
    kept = reports.join(links, "filename", "left").withColumn(
        "dossier_id", F.coalesce("_new", "dossier_id")
    ).drop("_new")
    added = once.join(reports.select("filename"), "filename", "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def split_unique(batch: DataFrame, dossiers: DataFrame, number: str = "dossier_number", row_id: str = "row_id"):
    """``(accepted, rejected)``. A number is rejected when it is stored already
    or taken by an earlier row of the batch; rows without a number pass."""
    has = F.coalesce(F.length(number) > 0, F.lit(False))
    with_number = batch.where(has)
    taken = with_number.join(dossiers.select(number).distinct(), number, "left_semi")
    free = with_number.join(dossiers.select(number).distinct(), number, "left_anti")
    first = free.groupBy(number).agg(F.min(row_id).alias("_first"))
    flagged = free.join(first, number)
    accepted = flagged.where(F.col(row_id) == F.col("_first")).drop("_first")
    rejected = flagged.where(F.col(row_id) != F.col("_first")).drop("_first").unionByName(taken)
    return accepted.select(batch.columns).unionByName(batch.where(~has)), rejected.select(batch.columns)


def apply_updates(
    table: DataFrame, updates: DataFrame, allowed: Sequence[str] = V.DOSSIER_FIELDS, key: str = "id",
    stamp: Column | None = None,
) -> DataFrame:
    """Overwrite allowed columns with the non-NULL values of a changes table
    and stamp changed rows. Changes that repeat a key are merged: per column the
    greatest non-NULL value holds, so no row is multiplied."""
    cols = [c for c in allowed if c in updates.columns and c in table.columns]
    new = updates.groupBy(key).agg(F.lit(True).alias("_hit"), *[F.max(c).alias(f"_new_{c}") for c in cols])
    joined = table.join(new, key, "left")
    out = []
    for c in table.columns:
        if c in cols:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        elif c == "updated_at" and stamp is not None:
            out.append(F.when(F.col("_hit"), stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def delete_parents(parents: DataFrame, children: DataFrame, ids: DataFrame, link: str = "dossier_id"):
    """``(parents, children)`` without the ids; their children lose the link."""
    gone = ids.select(F.col("id").alias(link), F.lit(True).alias("_gone")).distinct()
    kept = parents.join(ids.select("id").distinct(), "id", "left_anti")
    unlinked = lookup_join(children, gone, link, "left").withColumn(
        link, F.when(F.col("_gone").isNull(), F.col(link))
    ).drop("_gone")
    return kept, unlinked.select(children.columns)


def merge_tags(table: DataFrame, changes: DataFrame, key: str = "id", tags: str = "tags") -> DataFrame:
    """Apply a ``(id, tag, action)`` table; added tags are trimmed, lower-cased
    and distinct, removals win over the old tags."""
    clean = F.lower(strip(F.col("tag")))
    per_row = changes.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("action") == "add", clean))).alias("_add"),
        F.collect_set(F.when(F.col("action") == "remove", F.col("tag"))).alias("_drop"),
    )
    none = F.array().cast("array<string>")
    now = F.array_except(F.coalesce(tags, none), F.coalesce("_drop", none))
    merged = F.array_union(now, F.coalesce("_add", none))
    return table.join(per_row, key, "left").withColumn(
        tags, F.when(F.col("_add").isNull() & F.col("_drop").isNull(), F.col(tags)).otherwise(merged)
    ).select(table.columns)


def change_reports(
    reports: DataFrame, deletes: DataFrame | None = None, contents: DataFrame | None = None, content_chars: int | None = None
) -> DataFrame:
    """Drop reports by ``id`` and refresh contents by ``filename``; the
    character count follows the full new content. Of several contents for a file the
    longest counts, then the first in order. Contents stay whole unless
    ``content_chars`` is given."""
    if deletes is not None:
        reports = lookup_join(reports, deletes.select("id").distinct(), "id", "left_anti")
    if contents is not None:
        new = pick_first(contents, ["filename"], [-F.length("content_text"), F.col("content_text")], ["content_text"])
        new = new.withColumnRenamed("content_text", "_new")
        joined = reports.join(new, "filename", "left")
        reports = joined.withColumn(
            "char_count", F.coalesce(F.length("_new"), F.col("char_count"))
        ).withColumn("content_text", F.coalesce(F.col("_new") if content_chars is None else F.substring("_new", 1, content_chars), "content_text")).select(
            reports.columns
        )
    return reports


def notes_from_reports(reports: DataFrame) -> DataFrame:
    """Notes for the pipeline from stored reports with content."""
    return reports.where(F.length(strip(F.col("content_text"))) > 0).select(
        F.concat(F.lit("REPORT_"), F.col("id").cast("string")).alias("note_id"),
        F.col("content_text").alias("text"),
        F.col("id").alias("report_id"),
    )


# ---------------------------------------------------------------- dashboards
def kpis(dossiers: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of totals."""
    present = lambda c: F.when(F.length(c) > 0, F.col(c))
    d = dossiers.select(
        present("principal_diagnosis").alias("a"), present("origin").alias("b"), present("dossier_number").alias("c"),
        F.lit(1).alias("d"), F.lit(0).alias("r"),
    )
    none = F.lit(None).cast("string")
    r = reports.select(none.alias("a"), none.alias("b"), none.alias("c"), F.lit(0).alias("d"), F.lit(1).alias("r"))
    out = d.unionByName(r).agg(
        F.sum("d").alias("total_dossiers"), F.count_distinct("a").alias("unique_diagnoses"),
        F.count_distinct("b").alias("unique_cities"), F.count("c").alias("with_number"), F.sum("r").alias("total_reports"),
    )
    return out.withColumn(
        "reports_per_dossier",
        F.when(F.col("total_dossiers") > 0, F.round(F.col("total_reports") / F.col("total_dossiers"), 1)).otherwise(0.0),
    )


def histogram(table: DataFrame, label: Column, top: int | None = None) -> DataFrame:
    """``(label, value)`` of non-empty labels, largest first."""
    counts = table.select(label.alias("label")).where(F.length("label") > 0).groupBy("label").agg(
        F.count(F.lit(1)).alias("value")
    ).orderBy(F.desc("value"), "label")
    return counts.limit(top) if top else counts


def gender_label(c: Column) -> Column:
    out = F.lit(V.UNKNOWN)
    for code, label in V.GENDER_LABELS.items():
        out = F.when(c == code, label).otherwise(out)
    return out


def cut_label(c: Column, width: int = V.LABEL_CUT) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def monthly_trend(reports: DataFrame, today: str, months: int = 6, when: str = "created_at") -> DataFrame:
    """``(month, value)`` of the last calendar months, zero-filled."""
    spark = reports.sparkSession
    last = F.trunc(F.to_date(F.lit(today)), "month")
    frame = spark.range(1).select(
        F.explode(F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))).alias("month")
    )
    first = F.add_months(last, -(months - 1))
    recent = reports.where((F.col(when) >= first) & (F.col(when) < F.add_months(last, 1)))
    counts = recent.groupBy(F.trunc(F.col(when).cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return frame.join(counts, "month", "left").select("month", F.coalesce("value", F.lit(0)).alias("value")).orderBy("month")


def age_years(c: Column) -> Column:
    n = F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")
    return F.when(c.rlike("(?i)mois"), n / 12).otherwise(n.cast("double"))


def age_bucket(years: Column) -> Column:
    out = F.lit(V.AGE_BUCKETS[-1][1])
    for bar, label in reversed(V.AGE_BUCKETS[:-1]):
        out = F.when(years < bar, label).otherwise(out)
    return F.when(years.isNotNull(), out)


def age_histogram(dossiers: DataFrame, age: str = "age") -> DataFrame:
    """``(label, value)`` per age bucket; empty buckets are absent."""
    return dossiers.select(age_bucket(age_years(F.col(age))).alias("label")).where("label is not null").groupBy(
        "label"
    ).agg(F.count(F.lit(1)).alias("value"))


def most_recent(table: DataFrame, n: int = 5, when: str = "created_at", tie: str = "id") -> DataFrame:
    """Planned as take-ordered: every task keeps ``n`` rows."""
    return newest_first(table, when, tie).limit(n)


def run_summary(entities: DataFrame, numeric: DataFrame | None = None, key: str = "note_id") -> DataFrame:
    """Entity, matched, negated and numeric counts per note and category."""
    rows = entities.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if("matched").alias("matched_hpo"),
        F.count_if("negated").alias("negated_count"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in V.CATEGORIES],
    )
    if numeric is None:
        return rows
    n = numeric.groupBy(key).agg(F.count(F.lit(1)).alias("numeric_phenotypes"))
    return rows.join(n, key, "left").withColumn("numeric_phenotypes", F.coalesce("numeric_phenotypes", F.lit(0)))


