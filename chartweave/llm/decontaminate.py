"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import filter_texts, row_key, share, small_batches

#: Words of a seed, which is also the shortest tile, and the share of an item that tiles must cover.
SEED_WORDS, COVERAGE = 5, 0.8
#: Words of benchmark items that one broadcast index may hold; a larger benchmark takes more passes.
INDEX_WORDS = 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Everything but ASCII letters, digits and bytes of other letters parts words.
_PARTS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "doc_id long, text_key long, item_id long, item_words int, covered_words int, tiles int, coverage double"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of all other letters, A-Z lower-cased."""
    return (text or "").encode().lower().translate(_PARTS).split()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, by running sums.

    The odd base has an inverse modulo 2**64, which brings every window to the
    power 0: equal windows have equal hashes in any text.
    """
    if len(tokens) < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * _powers(_BASE, len(tokens) - 1))])
    return (sums[size:] - sums[:-size]) * _powers(_INVERSE, len(tokens) - size)


def _whole(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` that are free throughout."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[size:] - sums[:-size] == size)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, shortest: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) of greedy string tiling.

    Again and again the longest match of unmarked tokens is marked in both texts,
    ties by item start, then document start, until none of ``shortest`` tokens is
    left. The longest length is found by bisection: a match of some length holds
    one of every smaller length, so Karp-Rabin windows tell at once. Token 0 in
    ``doc`` matches nothing. Hits are compared token by token.

    Places of equal windows stand in one list per window, and a place that is taken
    never comes back, so a round passes every list once however often item and
    document repeat a word; no list of pairs is made.
    """
    free_item, free_doc = np.ones(len(item), bool), doc != 0
    tiles: list[tuple[int, int, int]] = []

    def windows(size: int) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
        """Free windows that both sides have: the item's (start, hash) and the document's starts by hash."""
        ours, theirs = window_hashes(item, size), window_hashes(doc, size)
        ours_at, theirs_at = _whole(free_item, size), _whole(free_doc, size)
        ours_at = ours_at[np.isin(ours[ours_at], theirs[theirs_at])]
        theirs_at = theirs_at[np.isin(theirs[theirs_at], ours[ours_at])]
        places: dict[int, list[int]] = {}
        for d, h in zip(theirs_at.tolist(), theirs[theirs_at].tolist(), strict=True):
            places.setdefault(h, []).append(d)
        return list(zip(ours_at.tolist(), ours[ours_at].tolist(), strict=True)), places

    def equal(i: int, d: int, size: int) -> bool:
        return np.array_equal(item[i : i + size], doc[d : d + size])

    def holds(size: int) -> bool:
        ours, places = windows(size)
        # The first place settles it but where different windows share a hash.
        return any(equal(i, places[h][0], size) for i, h in ours) or any(equal(i, d, size) for i, h in ours for d in places[h][1:])

    high = min(len(item), len(doc))
    while high >= shortest:
        low, size = shortest, 0
        while low <= high:
            middle = (low + high) // 2
            if holds(middle):
                size, low = middle, middle + 1
            else:
                high = middle - 1
        if not size:
            break
        ours, places = windows(size)
        waiting: dict[int, deque[int]] = {}
        for i, h in ours:
            # Tiles of a round have one length, so one that overlaps a window covers one of its ends.
            if not (free_item[i] and free_item[i + size - 1]):
                continue
            line, passed = waiting.setdefault(h, deque(places[h])), []
            while line:
                d = line.popleft()
                if not (free_doc[d] and free_doc[d + size - 1]):
                    continue
                if equal(i, d, size):
                    free_item[i : i + size] = free_doc[d : d + size] = False
                    tiles.append((i, d, size))
                    break
                passed.append(d)  # another window with this hash
            line.extendleft(reversed(passed))
        high = size
    return tiles


class BenchmarkIndex:
    """Seeds of a bounded part of the benchmark: every window of ``seed`` words with its places."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = SEED_WORDS):
        self.seed, self.ids, self.vocabulary = seed, [], {}
        self.tokens: list[np.ndarray] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            self.ids.append(item_id)
            self.tokens.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64))
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        # Items stand one after the other; a window's place is that of its first word among all words.
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        # Windows of items shorter than a seed have hashes of their own length.
        self.size = np.minimum(lengths, seed)
        windows = [window_hashes(t, n) for t, n in zip(self.tokens, self.size.tolist(), strict=True)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *windows])
        item = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        at = np.concatenate([np.zeros(0, np.int64), *[b + np.arange(len(w)) for b, w in zip(self.start.tolist(), windows, strict=False)]])
        # One sorted list of hashes and places per window length.
        self.seeds = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size[item] == size)
            own = own[np.argsort(hashes[own], kind="stable")]
            self.seeds[size] = hashes[own], at[own]

    def candidates(self, doc: np.ndarray) -> dict[int, int]:
        """Items that share seeds with ``doc``, each with how many of its words seeds cover."""
        covered: dict[int, int] = {}
        for size, (hashes, places) in self.seeds.items():
            found = np.unique(window_hashes(doc, size))
            first, last = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            first, count = first[first < last], (last - first)[first < last]
            if not len(first):
                continue
            at = np.sort(places[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
            # A window adds what the next one does not cover again; the next item's starts behind it.
            words = np.minimum(np.diff(at, append=at[-1] + size), size)
            item = np.searchsorted(self.start, at, "right") - 1
            begin = np.flatnonzero(np.diff(item, prepend=-1))
            covered.update(zip(item[begin].tolist(), np.add.reduceat(words, begin).tolist(), strict=True))
        return covered

    def held(self, text: str | None, coverage: float) -> list[tuple[int | None, int, int, int]]:
        """Items whose tiles cover enough: (item_id, words, covered words, tiles).

        The places that seeds cover bound an item's coverage from above, so only
        items that can reach the threshold are tiled.
        """
        known = self.vocabulary.get
        doc = np.array([known(w, 0) for w in words_of(text)], np.uint64)
        out = []
        for n, upper in (self.candidates(doc).items() if doc.any() else ()):
            item = self.tokens[n]
            if upper >= coverage * len(item):
                tiles = greedy_tiles(item, doc, min(self.seed, len(item)))
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item):
                    out.append((self.ids[n], len(item), covered, len(tiles)))
        return out


def indexes(benchmark: DataFrame, seed: int = SEED_WORDS, index_words: int = INDEX_WORDS) -> Iterator[BenchmarkIndex]:
    """The benchmark in parts of about ``index_words`` words, so that each part's index may be broadcast."""
    counts = benchmark.select("item_id", "text", F.floor(F.length(F.coalesce("text", F.lit(""))) / 2 + 1).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // index_words))
    for part in range(parts):
        items = counts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").collect()
        yield BenchmarkIndex([(r["item_id"], r["text"]) for r in items], seed)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS, index_words: int = INDEX_WORDS
) -> DataFrame:
    """Pairs (document, benchmark item) whose tiles cover at least ``coverage`` of the item's words.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Tiles are found
    anywhere in the whole text and in any order, so reordered passages count. Items
    of fewer than ``seed`` words must be held whole; items without words, null texts
    and empty tables match nothing. Rows repeating doc_id and text, and repeated
    items, give repeated pairs. Null ids are kept; other columns are ignored.

    The benchmark's index is broadcast in parts of at most ``index_words`` words,
    one pass over the documents each, so its size is bounded for any benchmark. A
    document meets the seeds where it lies: nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.float64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    out = None
    for index in indexes(benchmark, seed, index_words):
        shared = share(spark, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared()
            for batch in batches:
                rows = [
                    (doc_id, key, *found, found[2] / found[1])
                    for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
                    for found in own.held(text.as_py(), coverage)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = docs.select(*row_key(), "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS, index_words: int = INDEX_WORDS
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay as they are."""
    for index in indexes(benchmark, seed, index_words):
        shared = share(docs.sparkSession, index)

        def test(shared=shared) -> Callable[[str | None], bool]:
            own = shared()
            return lambda text: not own.held(text, coverage)

        docs = filter_texts(docs, test)
    return docs
