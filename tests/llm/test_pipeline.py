from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline as p
from chartweave.llm import decontaminate, language, packing
from tests.llm.test_exact_lines_packing import _check_pack, brute_exact
from tests.llm.test_minhash import brute_set

FOLDER = "/root/testdata/sf0.001"


def brute_roots(texts):
    """First text of the group of every text, linked by a five-word Jaccard similarity of 0.8 or more."""
    sets, root = [brute_set(t, 5) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if x == old else x for x in root]
    return root


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    names = docs.columns
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]

    predictor = language.Predictor(language.fit(docs))
    want = [r for r in rows if not predictor.predict(r[1])[2]]
    got = p.STAGES[0][1](spark, docs, FOLDER)
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(want)

    keep = {k[0] for k in brute_exact(want) if k[3]}
    got = p.STAGES[1][1](spark, got, FOLDER)
    want = [r for r in want if r[0] in keep]
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(want)

    want.sort()
    roots = brute_roots([r[1] for r in want])
    got = p.STAGES[2][1](spark, got, FOLDER)
    want = [r for n, r in enumerate(want) if roots[n] == n]
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(want)

    bench = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = lambda t: not any(b" " + b" ".join(b) + b" " in b" " + b" ".join(decontaminate.words_of(t)) + b" " for b in bench)
    got = p.STAGES[3][1](spark, got, FOLDER)
    left = [tuple(r) for r in got.collect()]
    assert got.columns == names and set(left) <= set(want) and all(clean(r[1]) for r in left)
    assert len(want) - len(left) == sum(not clean(r[1]) for r in want) > 0

    packed = p.STAGES[4][1](spark, got, FOLDER).collect()
    _check_pack(left, packed, packing.CAPACITY)
    assert {r.doc_id for r in p.run(spark, FOLDER).collect()} == {r[0] for r in left}


def test_near_copy_stage_leaves_no_near_copies_and_drops_nothing_else(spark):
    docs = p.exact_dedup(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "").cache()
    rows = sorted(map(tuple, docs.collect()))
    want = brute_roots([r[1] for r in rows])
    left = p.near_dedup(spark, docs, "")
    assert sorted(map(tuple, left.collect())) == [r for n, r in enumerate(rows) if want[n] == n] != rows


@pytest.mark.parametrize("stage", range(len(p.STAGES)))
def test_stages_take_odd_rows(spark, stage):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept string, _key string, name string"
    rows = [(1, None, None, None, None, "x", "y", "z"), (None, "some words here", "en", None, 3, None, None, None), (2, "", "en", "s", 0, None, None, None),
            (3, "same words", "en", None, None, None, None, None), (3, "same words", "en", None, None, None, None, None), (4, "long text " * 30_000, "de", "s", 9, None, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    out = p.STAGES[stage][1](spark, docs, FOLDER)
    assert out.count() > 0 and (stage == 4 or out.columns == docs.columns)
    assert p.STAGES[stage][1](spark, docs.limit(0), FOLDER).count() == 0
    if stage in (1, 2):
        assert out.where("doc_id = 3").count() == 1


def test_fingerprints_alone_find_near_copies_and_are_verified(spark, monkeypatch):
    from chartweave.llm import minhash, simhash

    words = [f"w{i * 7919 % 10007}" for i in range(1500)]
    bits = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    base, near = " ".join(words), [" ".join([*words[:n], "other", *words[n + 1 :]]) for n in (100, 900)]
    far = " ".join(f"v{i}" for i in range(400))
    assert all(bits(base, t) <= simhash.RADIUS for t in near) and bits(base, far) > simhash.RADIUS
    rows = [(4, base), (2, near[0]), (9, near[1]), (7, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = lambda reps, *more: reps.select(minhash.F.col("set_key").alias("a"), minhash.F.col("set_key").alias("b")).limit(0)
    monkeypatch.setattr(minhash, "candidates", none)
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, "").collect()) == [2, 7]
    monkeypatch.setattr(minhash, "links", lambda fps, radius: fps.crossJoin(fps.withColumnRenamed("fp", "b")).withColumnRenamed("fp", "a"))
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, "").collect()) == [2, 7]
