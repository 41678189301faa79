"""Evaluation against gold annotations.

Corpus metrics are plain aggregates with map-side combine; per-note steps never
group more than one note.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave import fixed_values as V
from chartweave.scale import lookup_join
from chartweave.session import materialise


def extracted_concepts(entities: DataFrame, numeric: DataFrame | None = None, key: str = "note_id") -> DataFrame:
    """M1: distinct ``(key, concept_id)``: affirmed entity ids and numeric ids."""
    ids = entities.where(F.col("hpo_id").isNotNull() & ~F.coalesce("negated", F.lit(False))).select(
        key, F.col("hpo_id").alias("concept_id")
    )
    if numeric is not None:
        ids = ids.unionByName(numeric.select(key, "concept_id"))
    return ids.distinct()


def equivalents(groups: DataFrame) -> DataFrame:
    """M2: ``(concept_id, equivalent)``: all members of all groups of a concept.

    A curated table of small groups; the result is not transitive.
    """
    other = groups.select("group_id", F.col("concept_id").alias("equivalent"))
    return groups.join(other, "group_id").select("concept_id", "equivalent").distinct()


def semantic_matches(
    extracted: DataFrame, expected: DataFrame, equivalence: DataFrame | None, near: DataFrame, key: str = "note_id"
) -> DataFrame:
    """M3: ``(key, tp, fn, fp, pairs)``.

    Pass 1 gives an expected id the smallest equal or equivalent extracted id; one
    extracted id may serve several. Pass 2 walks the leftovers in id order and
    gives each an unused extracted id related within the ``near`` ancestors, each
    used once. Candidates are a note's own pairs that stream past the concept tables,
    so no id is multiplied by its relatives before a shuffle; only the order-dependent
    choice is a fold over one note's candidate pairs.
    """
    ext = extracted.select(key, F.col("concept_id").alias("ext")).distinct()
    exp = expected.select(key, F.col("concept_id").alias("exp")).distinct()
    both = exp.join(ext, key)
    same = F.col("exp") == F.col("ext")
    if equivalence is not None:
        table = equivalence.select(F.col("concept_id").alias("exp"), F.col("equivalent").alias("ext")).distinct()
        both = lookup_join(both, materialise(table.withColumn("_same", F.lit(True))), ["exp", "ext"], "left")
        same = same | F.col("_same").isNotNull()
    first = both.where(same).groupBy(key, "exp").agg(F.min("ext").alias("ext"))
    left_exp = exp.join(first.select(key, "exp"), [key, "exp"], "left_anti")
    left_ext = ext.join(first.select(key, "ext").distinct(), [key, "ext"], "left_anti")
    up = near.select(F.col("term").alias("exp"), F.col("ancestor").alias("ext"))
    down = near.select(F.col("ancestor").alias("exp"), F.col("term").alias("ext"))
    related = materialise(up.union(down).distinct())
    pairs = lookup_join(left_exp.join(left_ext, key), related, ["exp", "ext"]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("exp", "ext"))).alias("c")
    )
    chosen = F.aggregate(
        "c",
        F.slice("c", 1, 0),
        lambda acc, p: F.when(
            F.exists(acc, lambda a: (a["exp"] == p["exp"]) | (a["ext"] == p["ext"])), acc
        ).otherwise(F.array_append(acc, p)),
    )
    second = pairs.select(key, F.explode(chosen).alias("p")).select(key, "p.exp", "p.ext")
    matched = first.unionByName(second).groupBy(key).agg(
        F.count(F.lit(1)).alias("tp"),
        F.count_distinct("ext").alias("used"),
        F.array_sort(F.collect_list(F.struct("ext", "exp"))).alias("pairs"),
    )
    sizes = (
        ext.groupBy(key).agg(F.count(F.lit(1)).alias("n_ext"))
        .join(exp.groupBy(key).agg(F.count(F.lit(1)).alias("n_exp")), key, "full")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sizes.join(matched, key, "left").select(
        key,
        zero("tp").alias("tp"),
        (zero("n_exp") - zero("tp")).alias("fn"),
        (zero("n_ext") - zero("used")).alias("fp"),
        zero("n_ext").alias("n_extracted"),
        zero("n_exp").alias("n_expected"),
        F.coalesce("pairs", F.expr("array()")).alias("pairs"),
    )


def _safe_f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def note_prf(matches: DataFrame) -> DataFrame:
    """M4: add ``precision``, ``recall`` and ``f1`` per note."""
    one = F.lit(1)
    return (
        matches.withColumn("recall", F.col("tp") / F.greatest("n_expected", one))
        .withColumn("precision", F.when(F.col("n_extracted") > 0, F.col("tp") / F.greatest("n_extracted", one)).otherwise(0.0))
        .withColumn("f1", _safe_f1(F.col("precision"), F.col("recall")))
    )


def corpus_prf(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M5: micro and macro precision, recall and F1 (macro F1 from macro P and R)."""
    sums = rows.groupBy(*by).agg(
        F.sum("tp").alias("total_tp"), F.sum("fn").alias("total_fn"), F.sum("n_extracted").alias("total_extracted"),
        F.avg("precision").alias("_p"), F.avg("recall").alias("_r"), F.count(F.lit(1)).alias("notes"),
    )
    p = F.col("total_tp") / F.greatest("total_extracted", F.lit(1))
    r = F.col("total_tp") / F.greatest(F.col("total_tp") + F.col("total_fn"), F.lit(1))
    return sums.select(
        *by,
        F.round(p, 4).alias("micro_precision"), F.round(r, 4).alias("micro_recall"),
        F.round(_safe_f1(p, r), 4).alias("micro_f1"),
        F.round("_p", 4).alias("macro_precision"), F.round("_r", 4).alias("macro_recall"),
        F.round(_safe_f1(F.col("_p"), F.col("_r")), 4).alias("macro_f1"),
        "total_tp", "total_fn", "total_extracted", "notes",
    )


def cascade_distribution(entities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M6: count, share and mean confidence per match type, largest first, with
    the overall total, matched and coverage on every row."""
    kind = F.when(F.col("matched"), F.col("match_type")).otherwise("no_match")
    counts = entities.groupBy(*by, kind.alias("match_type")).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("matched").alias("_matched"),
        F.avg(F.when(F.col("matched"), F.col("confidence"))).alias("_conf"),
    )
    w = Window.partitionBy(*by)  # one row per match type
    total, matched = F.sum("count").over(w), F.sum("_matched").over(w)
    return counts.select(
        *by, "match_type", "count",
        F.round(F.col("count") / F.greatest(total, F.lit(1)) * 100, 1).alias("pct"),
        F.round(F.coalesce("_conf", F.lit(0.0)), 3).alias("avg_conf"),
        total.alias("total"), matched.alias("matched"),
        F.round(matched / F.greatest(total, F.lit(1)), 3).alias("coverage"),
    ).orderBy(*by, F.desc("count"), "match_type")


def topk_accuracy(
    candidates: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), key: str = "note_id", by: Sequence[str] = ()
) -> DataFrame:
    """M7: share of gold notes whose disease ranks within k, by exact id."""
    found = candidates.select(key, "disease_id", "rank").join(
        gold.select(key, "disease_id", *by), [key, "disease_id"]
    ).groupBy(key).agg(F.min("rank").alias("gold_rank"))
    rows = gold.select(key, *by).join(found, key, "left")
    hit = lambda k: F.col("gold_rank").isNotNull() & (F.col("gold_rank") <= k)
    aggs = [F.count(F.lit(1)).alias("total")]
    for k in ks:
        aggs += [
            F.count_if(hit(k)).alias(f"top{k}"),
            F.round(F.count_if(hit(k)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias(f"top{k}_acc"),
        ]
    return rows.groupBy(*by).agg(*aggs)


def top_cues(entities: DataFrame, k: int = V.TOP_CUES) -> DataFrame:
    """M8: the ``k`` most frequent negation cues."""
    return (
        entities.where(F.col("negated") & F.col("negation_cue").isNotNull())
        .groupBy("negation_cue").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "negation_cue").limit(k)
    )


def detection_stats(notes: DataFrame, entities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M8: negated mentions, temporal and inconsistency warnings, reports."""
    zero = F.lit(0)
    per_note = notes.select(
        *by, F.size("temporal").alias("t"), F.size("inconsistencies").alias("i"), F.lit(1).alias("r"), zero.alias("n")
    )
    per_mention = entities.select(
        *by, zero.alias("t"), zero.alias("i"), zero.alias("r"), F.coalesce("negated", F.lit(False)).cast("int").alias("n")
    )
    return per_note.unionByName(per_mention).groupBy(*by).agg(
        F.sum("t").alias("temporal"), F.sum("i").alias("inconsistencies"), F.sum("r").alias("reports"),
        F.sum("n").alias("negated"),
    )


def compliance(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M9: documents with all required parts present and non-empty."""
    p = "phenopacket"
    ok = (
        (F.length(f"{p}.id") > 0) & F.col(f"{p}.subject").isNotNull()
        & (F.size(f"{p}.phenotypicFeatures") > 0) & F.col(f"{p}.metaData").isNotNull()
    )
    total = F.count(F.lit(1))
    return packets.groupBy(*by).agg(
        F.count_if(ok).alias("compliant"), total.alias("total"),
        F.round(F.sum(F.size(f"{p}.phenotypicFeatures")) / F.greatest(total, F.lit(1)), 1).alias("avg_features"),
        F.count_if(F.size(f"{p}.interpretations") > 0).alias("with_interpretations"),
        F.count_if(F.exists(f"{p}.phenotypicFeatures", lambda f: f["excluded"])).alias("with_excluded"),
    )


def compare_groups(metrics: DataFrame, group: str = "lang", groups: Sequence[str] = ("fr", "en")) -> DataFrame:
    """Long ``(group, metric, value)`` to one row per metric with the delta."""
    a, b = groups
    wide = metrics.groupBy("metric").pivot(group, list(groups)).agg(F.first("value"))
    return wide.withColumn("delta", F.col(a) - F.col(b))


def score_notes(packets: DataFrame, notes: DataFrame, entities: DataFrame, key: str = "note_id") -> DataFrame:
    """M11, note half: the five dimensions S, C, O, R, E in percent.

    An entity is traceable (E) when it has text and a match type or source.
    """
    ents = entities.where(F.col("category").isin(V.CATEGORIES)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("matched") | F.col("hpo_id").isNotNull()).alias("n_matched"),
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("conf"),
        F.count_if((F.length("text") > 0) & (F.length("match_type") > 0)).alias("n_trace"),
    )
    rows = packets.join(notes.select(key, "temporal", "inconsistencies"), key, "left").join(ents, key, "left")
    p = "phenopacket"
    point = lambda cond, w: F.when(cond, w).otherwise(0)
    s = (
        point(F.length(f"{p}.subject.id") > 0, 3)
        + point(F.col(f"{p}.subject.timeAtLastEncounter").isNotNull(), 3)
        + point(F.col(f"{p}.subject.sex").isNotNull() & (F.col(f"{p}.subject.sex") != "UNKNOWN_SEX"), 2)
        + point(F.size(f"{p}.phenotypicFeatures") > 0, 3)
        + point(F.size(f"{p}.interpretations") > 0, 2)
        + point(F.col(f"{p}.metaData").isNotNull(), 1)
    )
    n = F.coalesce("n", F.lit(0))
    warnings = F.coalesce(F.size("temporal"), F.lit(0)) + F.coalesce(F.size("inconsistencies"), F.lit(0))
    share = lambda c: F.coalesce(c, F.lit(0)) / F.greatest(n, F.lit(1)) * 100
    return rows.select(
        key,
        (s / 14 * 100).alias("S"),
        coherence(warnings, n).alias("C"),
        share(F.col("n_matched")).alias("O"),
        reliability(F.col("conf")).alias("R"),
        share(F.col("n_trace")).alias("E"),
    )


def coherence(warnings: Column, entities: Column) -> Column:
    """C: share of checks without a warning, at least five checks, within 0..100."""
    c = (1 - warnings / F.greatest(entities, F.lit(5))) * 100
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def reliability(mean_confidence: Column) -> Column:
    """R: mean non-zero confidence in percent, 50 when there is none."""
    return F.least(F.lit(100.0), F.coalesce(mean_confidence * 100, F.lit(50.0)))


def score_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M11, dataset half: mean, min and max per dimension, composite and rating."""
    aggs = [F.count(F.lit(1)).alias("n_reports")]
    for d in V.SCORE_WEIGHTS:
        aggs += [F.avg(d).alias(f"_{d}"), F.min(d).alias(f"_{d}_min"), F.max(d).alias(f"_{d}_max")]
    out = rows.groupBy(*by).agg(*aggs)
    composite = F.lit(0.0)
    for d, w in V.SCORE_WEIGHTS.items():
        composite = composite + F.col(f"_{d}") * w
    rating = F.lit(V.SCORE_RATINGS[-1][1])
    for bar, label in reversed(V.SCORE_RATINGS[:-1]):
        rating = F.when(composite >= bar, label).otherwise(rating)
    cols = []
    for d in V.SCORE_WEIGHTS:
        cols += [
            F.round(f"_{d}", 1).alias(f"{d}_mean"), F.round(f"_{d}_min", 1).alias(f"{d}_min"),
            F.round(f"_{d}_max", 1).alias(f"{d}_max"),
        ]
    return out.select(*by, "n_reports", *cols, F.round(composite, 1).alias("composite"), rating.alias("rating"))


def efficiency(rows: DataFrame, seconds: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """Mean seconds per report and report count."""
    return rows.groupBy(*by).agg(
        F.round(F.avg(seconds), 2).alias("avg_time"), F.count(F.lit(1)).alias("reports")
    )


def disease_prf(rows: DataFrame, disease: str = "disease") -> DataFrame:
    """Per disease, reports, gold size and mean precision, recall, F1."""
    return rows.groupBy(disease).agg(
        F.count(F.lit(1)).alias("reports"), F.sum("n_expected").alias("gold_size"),
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("f1"), 4).alias("f1"),
    )


def fill_rates(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows in which each field is filled, one row per field."""
    types = dict(rows.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields]).dtypes)
    aggs = []
    for f in fields:
        name = f.replace(".", "_")
        filled = F.col(f).isNotNull()
        if types[name].startswith("array"):
            filled = filled & (F.size(f) > 0)
        elif types[name] == "string":
            filled = filled & (F.length(f) > 0)
        aggs.append(F.round(F.avg(filled.cast("int")) * 100, 1).alias(name))
    wide = rows.groupBy(*by).agg(*aggs)
    names = [f.replace(".", "_") for f in fields]
    return wide.unpivot(list(by) if by else [], names, "field", "fill_pct")
