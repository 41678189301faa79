"""Near-duplicates by HyperMinHash: banded compressed registers, corrected estimates, verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import let_go, row_key, small_batches
from chartweave.llm.components import components
from chartweave.llm.simhash import SEED, fingerprint, keep_first, links
from chartweave.session import discard, materialise

#: Words of a shingle, and hundredths of the union that near copies share at least.
SHINGLE, PERCENT = 3, 85
#: Sketches of a text, each with its own hash function; a sketch has a register for each value of the hash's first bits.
BANDS, BUCKET_BITS = 24, 2
BUCKETS = 1 << BUCKET_BITS
#: Bits of a register's mantissa; the rest counts leading zeros.
MANTISSA = 10
EMPTY = (1 << 16) - 1
#: Values of a register in the digest that estimates use, besides "empty".
VALUES = 15
#: How often registers of different shingles have one digest value: by chance, or because zeros and mantissa agree.
COLLISION = 1 / VALUES + (1 - 1 / VALUES) / (3 << MANTISSA)
#: Standard deviations by which an estimate may fall short before its pair is dropped.
DEVIATIONS = 5.5
#: Sketches of a band's group, and texts and shingles of a component's tile, that one task compares with each other.
TILE, TEXTS, SHINGLES = 2048, 512, 2_000_000
#: Up to this size groups are compared together.
SMALL = 16
#: Shingles that are sketched at a time, and words whose hashes are remembered in a task.
CHUNK, WORDS = 1 << 12, 1 << 18

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, (BANDS + 8, 2), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word, SEED)
        return value


def shingles(text: str | None, known: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    many = min(shingle, len(own))
    if not many:
        return own
    mixed = np.full(len(own) - many + 1, many, np.uint64)
    for i in range(many):
        mixed += own[i : len(own) - many + 1 + i] * _ODD[BANDS + i % 8, 0]
    return np.unique(_spread(mixed))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(own: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set, one row per band: leading zeros and mantissa of each bucket's least hash.

    The first bits of a hash choose the bucket, the others are the number whose
    minimum counts. An empty bucket is told apart.
    """
    least = np.full((BANDS, BUCKETS), _MOST, np.uint64)
    for at in range(0, len(own), CHUNK):
        hashed = _spread(own[None, at : at + CHUNK] * _ODD[:BANDS, :1] + _ODD[:BANDS, 1:])
        bucket, rest = hashed >> np.uint64(64 - BUCKET_BITS), hashed << np.uint64(BUCKET_BITS)
        for b in range(BUCKETS):
            least[:, b] = np.minimum(least[:, b], np.where(bucket == b, rest, _MOST).min(axis=1))
    zeros = (53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (least << np.minimum(zeros, np.uint64(52)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return np.where(least == _MOST, EMPTY, zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: all its registers and its number."""
    joined = (regs.astype(np.uint64) << (np.uint64(16) * np.arange(BUCKETS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return _spread(joined * _ODD[:BANDS, 0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def digest(regs: np.ndarray) -> bytes:
    """Four bits per register, zero for an empty one."""
    flat = np.where(regs == EMPTY, 0, 1 + regs % VALUES).astype(np.uint8).ravel()
    return (flat[::2] << 4 | flat[1::2]).tobytes()


#: Zero halves of every byte.
_ZERO_HALVES = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)


def similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether digests (rows of bytes) may be of near copies: sizes allow it and the corrected estimate is no more than ``DEVIATIONS`` short.

    Of registers not empty in both, the share that agrees is the similarity plus
    collisions of the others, which the estimate takes off.
    """
    void = _ZERO_HALVES[a | b].sum(axis=-1, dtype=np.int64)
    seen = np.maximum(2 * a.shape[-1] - void, 1)
    agree = (_ZERO_HALVES[a ^ b].sum(axis=-1, dtype=np.int64) - void) / seen
    estimate = (agree - COLLISION) / (1 - COLLISION)
    share = percent / 100 + (1 - percent / 100) * COLLISION
    short = DEVIATIONS * sqrt(share * (1 - share)) / (1 - COLLISION) / np.sqrt(seen)
    return (estimate >= percent / 100 - short) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def sketches(docs: DataFrame, shingle: int = SHINGLE, marked: bool = False) -> DataFrame:
    """doc_id, text_key, n, set_key, keys, digest, fp of every row: the size and hash of its set, its band keys and digest (null
    without a set), and if ``marked`` the text's SimHash fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known = WordHashes()
        for batch in batches:
            sizes, sets, keys, digests, marks = [], [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), known, shingle)
                marks.append(fingerprint(text.as_py()) if marked and len(own) else 0)
                regs = registers(own) if len(own) else None
                sizes.append(len(own))
                sets.append(xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0)
                keys.append(None if regs is None else band_keys(regs))
                digests.append(None if regs is None else digest(regs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(np.array(sets, np.uint64).view(np.int64)),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(digests, pa.binary()), pa.array(np.array(marks, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "n", "set_key", "keys", "digest", "fp"],
            )

    schema = f"doc_id {kind}, text_key long, n long, set_key long, keys array<long>, digest binary, fp long"
    return docs.select(*row_key(), "text").mapInArrow(run, schema)


def forest(ids: np.ndarray, n: np.ndarray, marks: np.ndarray, percent: int, confirm=None) -> list[tuple[int, int]]:
    """Links that connect whatever is similar, a tree per component: each member is visited once and meets only those not yet reached."""
    left, links = np.arange(len(ids)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = left[similar(marks[left], marks[at], n[left], n[at], percent)]
            if confirm is not None:
                close = np.array([c for c in close.tolist() if confirm(at, c)], np.int64)
            if len(close):
                links += [(int(ids[at]), int(ids[c])) for c in close]
                queue += close.tolist()
                left = left[~np.isin(left, close, assume_unique=True)]
    return links


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _group_links(columns: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links within sorted groups: small ones all together, step by step, large ones each as a forest."""
    ids, n, marks = columns["set_key"], columns["n"], columns["digest"]
    sizes, links = ends - starts, []
    which = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for gap in range(1, SMALL):
        a = np.flatnonzero((which[gap:] == which[:-gap]) & (which[gap:] >= 0))
        if not len(a):
            break
        a = a[similar(marks[a], marks[a + gap], n[a], n[a + gap], percent)]
        links += zip(ids[a].tolist(), ids[a + gap].tolist(), strict=True)
    for g in np.flatnonzero(sizes > SMALL).tolist():
        s = slice(starts[g], ends[g])
        links += forest(ids[s], n[s], marks[s], percent)
    return links


def candidates(reps: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Possible links (a, b) of sets (set_key, n, keys, digest) that share a band, after the estimate.

    Sets at the threshold miss every band with a chance of 2e-8. A group of more than
    ``tile`` sets is cut into tiles that hold two of its parts each, so every pair of
    it meets in a task of bounded size; a forest of links leaves a group, not its pairs.
    """
    banded = reps.select("set_key", "n", "digest", F.explode("keys").alias("key"))
    large = materialise(
        reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile)
        .select("key", F.ceil(F.col("m") / tile).cast("int").alias("parts"))
    )
    group = ["key", "p", "q"]
    if large.isEmpty():
        tiled = banded.select(*[F.lit(0).alias(c) for c in ("p", "q")], "key", "set_key", "n", "digest")
    else:
        part, parts = F.pmod(F.xxhash64("set_key"), F.coalesce("parts", F.lit(1))).cast("int"), F.coalesce("parts", F.lit(1))
        tiled = banded.join(large, "key", "left").select("key", "set_key", "n", "digest", part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
        tiled = tiled.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "key", "set_key", "n", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*group, "set_key", "n")}
            rows["digest"] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(len(batch), -1)
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            if not len(rows["key"]):
                continue
            new = np.ones(len(rows["key"]), bool)
            new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in group], axis=0)
            starts = np.flatnonzero(new)
            last = starts[-1]
            held = {c: rows[c][last:] for c in rows}
            if last:
                yield _pairs(_group_links({c: v[:last] for c, v in rows.items()}, starts[:-1], starts[1:], percent))
        if held is not None:
            yield _pairs(_group_links(held, np.array([0]), np.array([len(held["key"])]), percent))

    small_batches(reps.sparkSession, 10_000)
    return tiled.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def fingerprint_links(reps: DataFrame, radius: int) -> DataFrame:
    """Possible links (a, b) that connect sets (set_key, fp) whose fingerprints differ in at most ``radius`` bits.

    Pivot tables link distinct fingerprints; each stands for its sets by the smallest of them.
    """
    first = materialise(reps.groupBy("fp").agg(F.min("set_key").alias("set_key")))
    near = materialise(links(first.select("fp"), radius))
    one, two = first.select(F.col("fp").alias("a"), F.col("set_key").alias("one")), first.select(F.col("fp").alias("b"), F.col("set_key").alias("two"))
    equal = reps.join(first.withColumnRenamed("set_key", "one"), "fp").where("set_key <> one").select(F.col("set_key").alias("a"), F.col("one").alias("b"))
    return near.join(one, "a").join(two, "b").select(F.col("one").alias("a"), F.col("two").alias("b")).unionByName(equal)


def verified(docs: DataFrame, reps: DataFrame, coarse: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, texts: int = TEXTS, cells: int = SHINGLES) -> DataFrame:
    """Links (a, b) of ``reps`` confirmed on full sets, within the components of possible links ``coarse`` (node, root).

    Each set is built once, from one text that has it, where its component is
    gathered. A component of more than ``texts`` sets or ``cells`` shingles is cut into
    tiles that hold two of its parts.
    """
    members = coarse.withColumnRenamed("node", "set_key").join(reps.select("set_key", "text_key", "n", "digest"), "set_key")
    most = F.ceil(F.greatest(F.count(F.lit(1)) / texts, F.sum("n") / cells)).cast("int")
    tiles = materialise(members.groupBy("root").agg(most.alias("parts")).where("parts > 1"))
    group = ["root", "p", "q"]
    parts = F.coalesce("parts", F.lit(1))
    dealt = members.join(tiles, "root", "left").select(
        "root", "set_key", "text_key", "n", "digest", F.pmod(F.xxhash64("set_key"), parts).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q")
    ).select("root", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "set_key", "text_key", "n", "digest")
    once = docs.select(row_key()[1], "text").dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, held = WordHashes(), None, []

        def told() -> pa.RecordBatch:
            ids, n, marks, sets = zip(*held, strict=True)

            def confirm(i: int, j: int) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

            return _pairs(forest(np.array(ids), np.array(n), np.stack([np.frombuffer(m, np.uint8) for m in marks]), percent, confirm))

        for batch in batches:
            for *at, key, n, mark, text in zip(*(batch.column(c) for c in (*group, "set_key", "n", "digest", "text")), strict=True):
                at = [x.as_py() for x in at]
                if at != now:
                    if held:
                        yield told()
                    now, held = at, []
                held.append((key.as_py(), n.as_py(), mark.as_py(), shingles(text.as_py(), known, shingle)))
        if held:
            yield told()

    small_batches(docs.sparkSession)
    gathered = dealt.join(once, "text_key").select(*group, "set_key", "n", "digest", "text")
    return gathered.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, texts: int = TEXTS, cells: int = SHINGLES, radius: int | None = None
) -> DataFrame:
    """Set size and component of every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are runs without ``[\\x20\\x09-\\x0D]``; a row's set are its
    distinct shingles of ``shingle`` words (by 64-bit hashes, equal sets by a 64-bit hash
    of all). Rows whose sets share ``percent`` hundredths of their union are linked;
    component_id is the smallest doc_id reachable, null ids aside. Null, empty and blank
    texts have no shingle and are linked with nothing. Sets too small to be similar
    without being equal are linked by equality. With a ``radius`` possible links are
    also those of SimHash fingerprints within so many bits, confirmed alike. Repeated rows have one set and so one
    component; other columns are ignored; an empty table gives an empty result.
    Returns doc_id, text_key, n, set_key, root (the component's smallest set), component_id.
    """
    own = materialise(sketches(docs, shingle, radius is not None))
    reps = materialise(own.where(F.col("n") * (100 - percent) >= percent).select("set_key", "n", "keys", "digest", "text_key", "fp").dropDuplicates(["set_key"]))
    possible = materialise(candidates(reps, percent, tile))
    let_go(docs.sparkSession)
    marked = possible if radius is None else materialise(possible.unionByName(fingerprint_links(reps, radius)))
    coarse = materialise(components(marked))
    discard(possible)
    found = materialise(verified(docs, reps.drop("keys", "fp"), coarse, shingle, percent, texts, cells))
    let_go(docs.sparkSession)
    root = components(found).withColumnRenamed("node", "set_key")
    full = own.where("n > 0").select("doc_id", "text_key", "n", "set_key")
    first = full.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    rooted = materialise(first.join(root, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(best, "root").select("set_key", "root", "component_id"))
    void = own.where("n = 0").select("doc_id", "text_key", "n", "set_key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return full.join(named, "set_key").select(void.columns).unionByName(void)


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, radius: int | None = None) -> DataFrame:
    """One row of each group of :func:`near_groups`: the smallest doc_id's; all columns stay, and so do rows without words."""
    grouped = materialise(near_groups(docs, shingle, percent, radius=radius))
    # Texts without words are no copies of each other: each row is its own group.
    alone = F.col("root").isNull()
    void = docs.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "")
    rest = docs.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) != "")
    return keep_first(rest, grouped.where(~alone)).unionByName(void)
