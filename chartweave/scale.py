"""Size-checked joins and skew-safe building blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A side is broadcast only if its planned size stays under this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rule and cue tables are compiled into expressions; this bounds their rows.
RULE_ROWS = 2000


#: Operators whose size Catalyst guesses from their input, whatever comes out.
_GUESSED = re.compile(r"Generate|LogicalRDD|ExternalRDD|MapIn|FlatMap|Expand|Join")
#: Bytes in memory per byte of a Parquet file, at most in what the engine writes.
UNPACKED = 4


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job is run), or None where it would be a guess."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if _GUESSED.search(plan.toString()):
        return None
    packed = UNPACKED if "Relation [" in plan.toString() else 1
    return packed * int(str(plan.stats().sizeInBytes()))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, whose size the planner knows."""
    kinds = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    arrow = pa.table({f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(kinds, columns, strict=True)})
    return spark.createDataFrame(arrow, schema=kinds)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on,
    how: str = "inner",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large left side with a dimension.

    The dimension is broadcast by hint only when its planned size is known and
    within ``limit_bytes``. Where it is a guess (exploded rows, rows of Python, other
    joins) nothing is forced: adaptive execution measures the shuffled side and
    broadcasts it if it is small, and splits skewed left partitions if it is not.
    """
    size = plan_bytes(right)
    if size is not None and size <= limit_bytes:
        right = F.broadcast(right)
    return left.join(right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row-local work enough tasks.

    A table read in fewer partitions than there are cores (one small file, say) is
    repartitioned; a table that already fills the cluster is returned as it is, so
    large inputs are never shuffled for this. What comes out of a shuffle is left to
    adaptive execution: its partitions are not known before it runs.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def pin(costly: Column) -> Column:
    """Keep a costly expression where it is written.

    A later filter on its result would otherwise be pushed below selective joins
    and be evaluated on rows those joins drop. The guard is always true; being
    non-deterministic, it stops the optimizer from moving or repeating it.
    """
    return F.when(F.spark_partition_id() >= 0, costly)


def bounded_rows(df: DataFrame, limit: int = RULE_ROWS) -> list[Row]:
    """Rows of a rule table, refused when there are more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table holds more than {limit} rows; join it instead")
    return rows


def pick_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], payload: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the smallest by ``order``.

    A ``min_by`` aggregate, so hot keys are reduced on the map side before the
    shuffle instead of being sorted whole in one window task. ``order`` must hold
    ascending expressions (negate numbers for descending).
    """
    keys = list(keys)
    payload = [c for c in (payload or df.columns) if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def flag_best(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], row_id: Sequence[str], flag: str
) -> DataFrame:
    """Keep all rows; ``flag`` is true on the smallest row by ``order`` per key.

    Aggregate then join back: the aggregate shrinks hot keys on the map side and
    adaptive execution may split them in the join.
    """
    keys, row_id = list(keys), list(row_id)
    winner = pick_first(df, keys, order, row_id)
    win = winner.select(*keys, *[F.col(c).alias(f"_win_{c}") for c in row_id])
    is_best = F.lit(True)
    for c in row_id:
        is_best = is_best & F.col(c).eqNullSafe(F.col(f"_win_{c}"))
    return df.join(win, keys, "left").withColumn(flag, F.coalesce(is_best, F.lit(False))).drop(
        *[f"_win_{c}" for c in row_id]
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    The ``rank <= k`` filter right above ``row_number`` lets Spark insert its
    window-group limit below the shuffle, so every map task ships at most ``k``
    rows per key however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
