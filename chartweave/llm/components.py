"""Connected components of an edge table by alternating stars, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.session import discard, materialise


def _toward(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours; a hot u is reduced map-side, then joined."""
    least = own.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): root is the component's smallest node.

    Large-star and small-star steps in turn until nothing changes. Every round is
    written to the shared folder, so a lost executor costs one round; the driver
    sees two numbers a round. Stars that still change after ``most_rounds`` are an error.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both, both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = materialise(large)
        small = _toward(stars, stars)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.where("u <> m").select("u", F.col("m").alias("v"))
        ).distinct()
        after = materialise(small)
        discard(stars)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
