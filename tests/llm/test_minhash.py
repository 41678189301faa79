import random
from itertools import combinations

import numpy as np
import pytest

from chartweave.llm import minhash as m


def brute_set(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=85):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if x == old else x for x in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def copies(rng, base, n, most):
    """Texts with up to ``most`` of their words replaced."""
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def made():
    rng = random.Random(4)
    texts = [f"Lone {i} text of its own {' '.join(str(rng.random()) for _ in range(20))}" for i in range(30)]
    for length, most in ((8, 1), (12, 1), (40, 3), (200, 12), (1500, 60)):
        texts += copies(rng, [f"w{rng.randrange(10**6)}" for _ in range(length)], 25, most)
    return [(i, t) for i, t in enumerate(texts)]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, set_key string, n int")
    return sorted(((r.doc_id, r.n, r.component_id) for r in m.near_groups(docs, **more).collect()), key=str)


def test_registers_hold_the_least_hash_of_every_bucket():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 9000, dtype=np.uint64))
    got = m.registers(own)
    for band in (0, m.BANDS - 1):
        least = [None] * m.BUCKETS
        for h in m._spread(own * m._ODD[band, 0] + m._ODD[band, 1]).tolist():
            b, rest = h >> 62, h << 2 & (1 << 64) - 1
            least[b] = rest if least[b] is None else min(least[b], rest)
        for b in range(m.BUCKETS):
            zeros = 64 - least[b].bit_length()
            assert got[band, b] == zeros << 10 | (least[b] << zeros + 1 & (1 << 64) - 1) >> 54
    assert (m.registers(own[:1]) == m.EMPTY).sum() == m.BANDS * (m.BUCKETS - 1)


def test_estimates_are_near_and_drop_far_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    mark = lambda own: np.frombuffer(m.digest(m.registers(np.unique(own))), np.uint8)
    for share, want in ((0.95, True), (0.86, True), (0.4, False), (0.1, False)):
        near = 0
        for _ in range(40):
            cut = int(len(base) * 2 * share / (1 + share))
            other = np.concatenate([rng.permutation(base)[:cut], rng.integers(0, 1 << 63, len(base) - cut, dtype=np.uint64)])
            near += bool(m.similar(mark(base), mark(other), np.int64(3000), np.int64(3000)))
        assert near == 40 * want


@pytest.mark.parametrize(("tile", "texts", "cells"), [(2048, 512, 2_000_000), (8, 6, 2_000_000), (20, 512, 900)])
def test_equals_brute_force(spark, tile, texts, cells):
    rows = made()
    assert run(spark, rows, tile=tile, texts=texts, cells=cells) == brute(rows)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (1, None), (2, ""), (4, " \x0b\n"), (None, base), (6, "one"), (7, "ONE"), (8, "one two"), (5, base), (10, "a b c d e f g"),
            (11, "a b c d e f g h"), (12, "long text " * 60_000), (13, "long  text\t" * 60_000), (14, "x\x1cy z q"), (15, "x y z q"), (None, "alone under null"), (None, "another one here")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "x")]) == [(1, 0, 1), (2, 1, 2)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, stay string")
    left = m.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, [3, 1, 2, 4, 6, 8, 10, 11, 12, 14, 15, None, None]))


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = entry.queries()["op11_minhash_near_dedup"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
