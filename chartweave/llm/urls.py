"""URL filters: rules and listed hosts as Bloom filter cascades that are exact on the corpus's keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import ascii_lower, share, small_batches
from chartweave.session import materialise

#: Bits and hash functions per key of a filter.
BITS, HASHES = 10, 4
#: Listed keys that one cascade holds; a longer list takes several, one after the other.
CASCADE_KEYS = 20_000_000

JUDGED = "page_id long, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: str) -> list[str]:
    """A host and the domains above it."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys under which a rule for this page would be listed: domain and path start."""
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [domain + start for domain in suffixes(host) for start in starts]


def universe(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """The distinct keys of all pages (host, path), by native expressions; hot hosts are reduced map-side."""
    labels = F.split("host", "\\.", -1)
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    starts = F.filter(
        F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()
    )
    return pages.select("host", starts.alias("starts")).distinct().select(
        F.explode(domains).alias("domain"), "starts"
    ).distinct().select("domain", F.explode("starts").alias("start")).select(F.concat("domain", "start").alias("key")).distinct()


def positions(keys: list[str], level: int, bits: int, hashes: int = HASHES) -> np.ndarray:
    """Filter bits of every key at a level: double hashing of two halves of one hash."""
    from xxhash import xxh64_intdigest

    own = np.array([xxh64_intdigest(k, level) for k in keys], np.uint64)
    first, step = own >> np.uint64(32), (own & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (first[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


@dataclass
class Cascade:
    """Levels of Bloom filters: odd ones hold listed keys, even ones the false positives before them."""

    levels: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)

    def passes(self, keys: list[str], level: int) -> np.ndarray:
        at = positions(keys, level, self.sizes[level], self.hashes[level])
        words = self.levels[level][(at >> np.uint64(6)).astype(np.int64)]
        return ((words >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1) if len(keys) else np.zeros(0, bool)

    def listed(self, keys: list[str]) -> np.ndarray:
        """Exact membership of keys of the universe: the first level that a key fails tells."""
        found, open_keys = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            passed = self.passes([keys[i] for i in open_keys], level)
            found[open_keys[~passed]] = level % 2 == 1
            open_keys = open_keys[passed]
        found[open_keys] = len(self.levels) % 2 == 1
        return found


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    shared = share(keys.sparkSession, cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            yield batch.filter(pa.array(own.passes(batch.column(0).to_pylist(), level)))

    return keys.mapInArrow(run, "key string")


def _filter_words(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """The bits of ``keys``, or-ed map-side; two columns with one number per 64 bits come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(batch.column(0).to_pylist(), level, bits, hashes).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    word = keys.mapInArrow(run, "at long").groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
    )
    found = word.toArrow()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def width(inside: int, outside: int, least: int = BITS) -> tuple[int, int]:
    """Bits and hashes of a key, so that about half as many of ``outside`` other keys pass as there are inside.

    They grow with the logarithm of other keys to one inside, so that the filters of
    all levels together stay in proportion to the listed keys.
    """
    hashes = max(HASHES, ceil(log2(max(1, 2 * outside / inside))))
    return (least, HASHES) if hashes == HASHES else (max(least, ceil(hashes / log(2))), hashes)


def build_cascade(listed: DataFrame, known: DataFrame, bits: int = BITS) -> Cascade:
    """A cascade for the ``key`` values of ``listed`` that is exact on ``known``.

    Level by level the keys of the other side that pass are encoded next, until none
    pass. The first level is wide enough for the complete key universe (:func:`width`),
    so that no later one holds more keys than are listed. Each is written once.
    """
    cascade = Cascade()
    inside = materialise(known.join(listed, "key", "left_semi"))
    outside = materialise(known.join(listed, "key", "left_anti"))
    n = inside.count()
    while n:
        own, hashes = width(n, outside.count(), bits)
        size = max(64, own * n)
        cascade.levels.append(_filter_words(inside, len(cascade.levels), size, hashes))
        cascade.sizes.append(size)
        cascade.hashes.append(hashes)
        inside, outside = materialise(_passing(outside, cascade, len(cascade.levels) - 1)), inside
        n = inside.count()
    return cascade


def judge(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, bits: int = BITS, cascade_keys: int = CASCADE_KEYS
) -> DataFrame:
    """Host, path, fitting rule and verdict of every page (page_id, url).

    ``rules`` has action (allow or block), host and path; a rule fits its host and
    all subdomains if the page's path starts with the rule's, and the longest
    fitting rule decides. Where none fits, a page of a host in ``listed`` (key), or
    below one, is blocked and any other allowed. A null URL, or one without
    ``://``, has an empty host and path and fits no rule. Rules with a null column
    or an empty host are left out; of a rule given for both actions block holds.
    Repeated rows and null ids are judged like any other, other columns are
    ignored, and empty tables are no special case.

    Membership is read from cascades built over the complete keys of ``pages``, so
    no page is joined or shuffled; a list of more than ``cascade_keys`` keys is cut
    into cascades applied one after the other.
    """
    small_batches(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    clean = rules.where("action is not null and host <> '' and path is not null").select(
        "action", F.concat(ascii_lower(F.col("host")), "path").alias("key"), F.char_length("path").alias("n")
    ).distinct()
    lengths = sorted(r["n"] for r in clean.select("n").distinct().collect())
    ruled = materialise(universe(parts, lengths)) if lengths else None
    hosts = materialise(universe(parts, [0]))
    steps: list[tuple[str, DataFrame, DataFrame]] = []
    if ruled is not None:
        steps += [(action, clean.where(F.col("action") == action).select("key").distinct(), ruled) for action in ("allow", "block")]
    steps.append(("listed", listed.where("key <> ''").select(ascii_lower(F.col("key")).alias("key")).distinct(), hosts))

    judged = parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for action, keys, known in steps:
        shares = max(1, -(-keys.count() // cascade_keys))
        for turn in range(shares):
            own = keys.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == turn)
            shared = share(pages.sparkSession, build_cascade(own, known, bits))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, action=action) -> Iterator[pa.RecordBatch]:
                cascade = shared()
                for batch in batches:
                    columns = batch.to_pydict()
                    found = [suffixes(h) if action == "listed" else keys_of(h, p, lengths)
                             for h, p in zip(columns["host"], columns["path"], strict=True)]
                    flat = sorted({k for own in found for k in own})
                    members = {k for k, hit in zip(flat, cascade.listed(flat), strict=True) if hit}
                    for n, own in enumerate(found):
                        hits = [k for k in own if k in members]
                        if not hits:
                            continue
                        best, rule = max(hits, key=len), columns["rule"][n]
                        if action == "listed":
                            columns["verdict"][n] = columns["verdict"][n] or "block"
                        elif rule is None or len(best) > len(rule) or len(best) == len(rule) and action == "block":
                            columns["rule"][n], columns["verdict"][n] = best, action
                    yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)

            judged = judged.mapInArrow(run, JUDGED)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
