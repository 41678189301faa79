import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chartweave.llm import simhash as s
from chartweave.llm.components import components


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b\x0bc d", "É é x y z w", "a b c d e " * 40, "x\x1cy z q w"])
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_counts_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    want = s.fingerprint(text)
    monkeypatch.setattr(s, "CHUNK", 7)
    assert s.fingerprint(text) == want == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=1, max_size=40, unique=True), st.integers(1, 3))
def test_bucket_links_connect_like_brute_force(fps, radius):
    found = s.bucket_links(np.array(fps, np.uint64), radius, s.references(8))
    assert len(found) < len(fps) and all((a ^ b).bit_count() <= radius for a, b in found)
    root = {f: f for f in fps}
    for a, b in found:
        old, new = root[b], root[a]
        root = {k: new if v == old else v for k, v in root.items()}
    want = brute_components(fps, radius)
    for i in range(len(fps)):
        for j in range(i):
            assert (root[fps[i]] == root[fps[j]]) == (want[i] == want[j])


def _flips(rng, base, n, most):
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_lose_nothing(spark, tile):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    for base in (fps[0], fps[1], 0):
        fps += _flips(rng, base, 70, 6)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(s.links(df, tile=tile)).collect()}
    want = brute_components(fps, 4)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(x)
    for g in groups.values():
        roots = {got.get(x, x) for x in g}
        assert roots == {min(g)}


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_are_cut_short_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        components(path, 1)


def test_near_groups_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base + " tail", None), (9, "other words " * 9, None), (1, None, None), (2, "", "x"), (None, base, None),
            (5, base, "a"), (8, "long " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.text_key): r.component_id for r in s.near_groups(docs).collect()}
    want = brute_components([brute_fingerprint(t) for _, t, _ in rows], 4)
    by_id = {r[0]: w for r, w in zip(rows, want, strict=True)}
    for (doc_id, _), comp in got.items():
        assert comp == min(d for d, w in by_id.items() if d is not None and w == by_id[doc_id])
    left = s.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(got.values()))
    assert s.near_groups(docs.limit(0)).count() == 0


def test_unrelated_texts_stay_under_null_and_repeated_ids(spark):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (None, text(1)), (7, text(2))]
    left = s.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(None, text(1)), (7, text(2)), (None, text(3)), (5, text(4)), (5, text(5))]))


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps, 4)
    first = {}
    for r, root in zip(rows, roots, strict=True):
        first[root] = min(first.get(root, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{f:016x}", first[root]) for r, f, root in zip(rows, fps, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op2_simhash_near_dedup"](spark, folder).collect()}
    assert got == want
