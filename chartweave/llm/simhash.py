"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import keep_rows, row_key, small_batches
from chartweave.llm.components import components
from chartweave.session import materialise

#: Words of a shingle, differing bits of a link, and the seed of the shingle hash.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Runs of bits the fingerprint is cut into; pairs agree on ``BLOCKS - RADIUS`` of them.
BLOCKS = 6
#: Reference fingerprints whose distances are tabled.
PIVOTS = 16
#: Fingerprints of a bucket that one task compares; larger buckets are tiled.
TILE = 4096
#: Up to this size buckets are compared together, each pair once.
SMALL = 16
#: Shingles that are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        widths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        after = np.cumsum(widths)
        starts, ends = (after - widths)[: 1 - shingle].tolist(), (after - 1)[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint of every row: doc_id, text_key, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(*row_key(), fp("text").alias("fp"))


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random bits."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every ``blocks - radius`` blocks: ``radius`` differing bits leave one of them whole."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def bucket_links(fps: np.ndarray, radius: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints of one bucket are within ``radius``, a tree per component.

    The bucket's distances to all pivots are tabled once. By the triangle
    inequality two fingerprints within ``radius`` differ by no more in any
    coordinate, so a larger maximum difference discards a pair; survivors are
    verified bit by bit. Every fingerprint is visited once and meets only those
    not yet reached, so no more than one link per fingerprint leaves the bucket.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.abs(table[left, 0] - table[at, 0]) <= radius
            close = left[near]
            close = close[np.abs(table[close] - table[at]).max(axis=1, initial=0) <= radius]
            close = close[np.bitwise_count(fps[close] ^ fps[at]) <= radius]
            if len(close):
                links += [(int(fps[at]), int(fps[c])) for c in close]
                queue += close.tolist()
                left = left[~np.isin(left, close, assume_unique=True)]
    return links


def small_bucket_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """All links within many buckets of at most ``SMALL`` fingerprints, filtered and verified the same way."""
    which = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    links = []
    for step in range(1, SMALL):
        a = np.flatnonzero((which[step:] == which[:-step]) & (which[step:] >= 0))
        if not len(a):
            break
        b = a + step
        for pivot in pivots:
            same = np.abs(
                np.bitwise_count(fps[a] ^ pivot).astype(np.int8) - np.bitwise_count(fps[b] ^ pivot).astype(np.int8)
            ) <= radius
            a, b = a[same], b[same]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        links += zip(fps[a[near]].tolist(), fps[b[near]].tolist(), strict=True)
    return links


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``radius`` bits of each other.

    Fingerprints are dealt to buckets by the bits of every mask, so each pair within
    ``radius`` shares a bucket. A bucket of more than ``tile`` fingerprints is cut
    into tiles that each hold two of its parts, so every pair still meets in a task
    of bounded size.
    """
    small_batches(distinct.sparkSession, 20_000)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks(blocks, radius))])
    dealt = distinct.select("fp", F.explode(keys).alias("b")).select("fp", "b.t", "b.k")
    large = materialise(
        dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
        .select("t", "k", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    tiled = dealt.join(large, ["t", "k"], "left").select(
        "fp", "t", "k", part.alias("p"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("q")
    ).select("fp", "t", "k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    pivot_table = references(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        names, held = ["t", "k", "p", "q"], None
        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in [*names, "fp"]}
            if held is not None:
                rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
            new = np.zeros(len(rows["fp"]), bool)
            new[:1] = True
            for n in names:
                new[1:] |= rows[n][1:] != rows[n][:-1]
            starts = np.flatnonzero(new)
            held = {n: rows[n][starts[-1] :] for n in rows} if len(starts) else None
            if held is None:
                continue
            fps, sizes = rows["fp"].view(np.uint64), np.diff(starts)
            found = small_bucket_links(fps[: starts[-1]], starts, sizes, radius, pivot_table)
            for n in np.flatnonzero(sizes > SMALL).tolist():
                found += bucket_links(fps[starts[n] : starts[n + 1]], radius, pivot_table)
            yield told(found)
        if held is not None and len(held["fp"]) > 1:
            yield told(bucket_links(held["fp"].view(np.uint64), radius, pivot_table))

    return tiled.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are runs without ``[\\x20\\x09-\\x0D]``, shingles are
    ``shingle`` space-joined words with repeats; a shorter text is one shingle, a
    null, empty or blank one has fingerprint 0 and is linked like any other. Rows
    link at ``radius`` or fewer differing bits; component_id is the smallest doc_id
    reachable, itself included, null ids aside. Repeated rows share a fingerprint
    and so a component. Other columns are ignored; an empty table gives an empty
    result. Returns doc_id, text_key, fp, root (the component's smallest fingerprint), component_id.
    """
    own = materialise(fingerprints(docs, shingle))
    root = components(materialise(links(own.select("fp").distinct(), radius, blocks, tile=tile))).withColumnRenamed("node", "fp")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialise(first.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(best, "root").select("fp", "root", "component_id"))
    return own.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hex_digits(fp):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``grouped`` (doc_id, text_key, root): the smallest doc_id's, null ids last."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    best = grouped.groupBy("root").agg(F.min(order).alias("s")).select(
        F.col("s.doc_id").alias("_doc"), F.col("s.text_key").alias("_key")
    )
    rows = grouped.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    return keep_rows(docs, rows.join(
        best, rows["doc_id"].eqNullSafe(best["_doc"]) & (rows["text_key"] == best["_key"])
    ).select("doc_id", "text_key", "rows", F.lit(1).cast("long").alias("stay")))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of :func:`near_groups`: the smallest doc_id's; all columns stay as they are.

    Groups are told apart by their root: component_id is null for all groups without
    an id, and equal where unrelated texts repeat an id.
    """
    return keep_first(docs, materialise(near_groups(docs, radius, shingle)))
