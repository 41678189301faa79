"""Centroid clustering over Hilbert-ordered blocks whose boxes rule centroids out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import small_batches
from chartweave.scale import literal_table
from chartweave.session import materialise

#: Components of a vector, whole steps of a unit, and the largest whole number; distances then fit a long.
WIDTH, STEPS, MOST = 64, 256, 1 << 27
#: Centroids, rounds, and the number in front of an id whose digest picks the first centroids.
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Vectors of a block.
BLOCK = 256
#: Axes of the curve and bits of each.
AXES, BITS = 8, 4
#: Vectors that the curve's axes are fitted on. They only decide which vectors share a block.
SAMPLE = 4096


def whole(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that count: exactly ``WIDTH`` components, all finite, as whole numbers ``floor(256 * x)``.

    Numbers beyond 2^27 either way are set to that bound, so that distances fit a long.
    """
    odd = F.exists(vec, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    near = lambda e: F.least(F.greatest(e.cast("double") * STEPS, F.lit(float(-MOST))), F.lit(float(MOST)))
    return vectors.where((F.size(vec) == WIDTH) & ~F.coalesce(odd, F.lit(True))).select(
        "vec_id", F.transform(vec, lambda e: F.floor(near(e)).cast("int")).alias("x")
    )


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the least digests; fewer where there are fewer. Ties of an id go by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, WIDTH)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every cell (a row of coordinates below ``2 ** bits``) on the Hilbert curve; bits times axes is at most 63."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swapped)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> bit & 1
    return key


@dataclass(frozen=True)
class Curve:
    """Principal axes of a bounded sample and, for the first of them, the edges of their cells."""

    axes: np.ndarray
    edges: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray) -> Curve:
        centred = sample - sample.mean(axis=0)
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        cuts = np.arange(1, 1 << BITS) / (1 << BITS)
        return Curve(axes, np.quantile(sample @ axes[:, :AXES], cuts, axis=0).T)

    def keys(self, x: np.ndarray) -> np.ndarray:
        turned = x @ self.axes[:, :AXES]
        return hilbert_keys(np.stack([np.searchsorted(e, turned[:, i]) for i, e in enumerate(self.edges)], axis=1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.int64)


def blocks(kept: DataFrame, curve: Curve, size: int = BLOCK) -> DataFrame:
    """Vectors in the curve's order, ``size`` to a row: ids, data (32-bit numbers), low and high (their box on the curve's axes).

    Range partitions of the key and a hash of the id, so that equal vectors are spread too.
    """
    kind = kept.schema["vec_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            data = [row.tobytes() for row in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve.keys(x)), pa.array(data, pa.binary())], names=["vec_id", "place", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, data: list[bytes]) -> pa.RecordBatch:
            rows = []
            for at in range(0, len(ids), size):
                held = b"".join(data[at : at + size])
                turned = np.frombuffer(held, "<i4").reshape(-1, WIDTH) @ curve.axes
                rows.append((ids[at : at + size], held, turned.min(axis=0).tobytes(), turned.max(axis=0).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        ids, data, out = [], [], None
        for batch in batches:
            out = out or pa.schema([("ids", pa.list_(batch.schema.field("vec_id").type)), ("data", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
            ids += batch.column("vec_id").to_pylist()
            data += batch.column("data").to_pylist()
            if full := len(ids) // size * size:
                yield told(ids[:full], data[:full])
                ids, data = ids[full:], data[full:]
        if ids:
            yield told(ids, data)

    small_batches(kept.sparkSession, 4096)
    placed = kept.mapInArrow(keyed, f"vec_id {kind}, place long, data binary").withColumn("spread", F.xxhash64("vec_id"))
    ordered = placed.repartitionByRange("place", "spread").sortWithinPartitions("place", "spread")
    return ordered.mapInArrow(packed, f"ids array<{kind}>, data binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ascending.

    Against the centroid nearest to the box's middle, the difference of the two
    squared distances is linear in the vector, so its least value over the box is
    exact; a centroid farther by more than rounding everywhere in the box is out.
    """
    squares = (turned**2).sum(axis=1)
    middle = (low + high) / 2
    best = int(np.argmin(((turned - middle) ** 2).sum(axis=1)))
    apart = turned - turned[best]
    least = squares - squares[best] - 2 * np.where(apart > 0, apart * high, apart * low).sum(axis=1)
    slack = 1e-9 * (squares + squares[best] + np.abs(apart) @ np.maximum(np.abs(low), np.abs(high)) + 1)
    return np.flatnonzero(least <= slack)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22:  # products stay exact in doubles
        across = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        across = x @ centroids.T
    return (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :] - 2 * across


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector of a block and its squared distance; ties go to the smaller number."""
    able = candidates(low, high, turned)
    found = squared_distances(x, centroids[able])
    at = found.argmin(axis=1)
    return able[at], found[np.arange(len(x)), at]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    turned = centroids @ axes
    for batch in batches:
        ids = batch.column("ids")
        for n, (data, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("data", "low", "high")), strict=True)):
            x = np.frombuffer(data, "<i4").reshape(-1, WIDTH).astype(np.int64)
            yield ids[n].values, x, *nearest(x, np.frombuffer(low), np.frombuffer(high), centroids, turned)


def next_centroids(table: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every centroid's vectors; one without vectors stays.

    Each task adds up its own blocks, the sums are added per component; the driver
    sees one number per centroid and component.
    """
    k = len(centroids)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, WIDTH + 1), np.int64)
        for _, x, own, _ in _assigned(batches, centroids, axes):
            for c in np.unique(own).tolist():
                part = x[own == c]
                sums[c, 0] += len(part)
                sums[c, 1:] += part.sum(axis=0)
        met = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = table.mapInArrow(added, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
    totals = np.zeros((k, WIDTH + 1), np.int64)
    for r in parts.groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect():
        totals[r.cluster, r.i] = r.s
    full = totals[:, 0] > 0
    out = centroids.copy()
    out[full] = totals[full, 1:] // totals[full, :1]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = BLOCK) -> DataFrame:
    """Cluster, squared distance and sums of every vector of ``vectors`` (vec_id, embedding) that counts (:func:`whole`).

    ``k`` vectors chosen by digest start as centroids; each round assigns every vector
    to the nearest one and replaces it by the floor of their mean. Vectors are laid
    out once, in blocks along a Hilbert curve; in every round a block is compared
    only with the centroids its box allows, exactly. Vectors that are null, of another
    width or not finite are left out; rows that repeat an id count one by one; null
    ids rank as an empty one; other columns are ignored; with no vector left the
    result is empty. inertia is null where it exceeds a long. Returns vec_id, cluster,
    distance, cluster_inertia, inertia, centroid_sha256.
    """
    spark = vectors.sparkSession
    kept = whole(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sample = kept.orderBy(F.xxhash64("vec_id"), "x").limit(SAMPLE).select("x").collect()
    curve = Curve.fit(np.array([r.x for r in sample], np.float64))
    table = materialise(blocks(kept, curve, size))
    small_batches(spark, 64)
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, curve.axes)
    axes = curve.axes

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, own, far in _assigned(batches, centroids, axes):
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    found = materialise(table.mapInArrow(told, f"vec_id {kind}, cluster int, distance long"))
    own = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in own.values() or sum(own.values()) >= 1 << 63 else sum(own.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, total, names[c]) for c, s in own.items()]
    sums = literal_table(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid: at most k rows are broadcast.
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
