import hashlib
import math

import numpy as np
import pytest

from chartweave.llm import clusters as c


def brute(rows, k=c.CENTROIDS, rounds=c.ROUNDS):
    kept = [(i, [math.floor(256 * float(e)) for e in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, cent, strict=True)), n) for n, cent in enumerate(cents))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for n in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    sums = [sum(d for _, d, o in found if o == n) for n in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in cents]
    return sorted(((i, o, d, sums[o], sum(sums), names[o]) for i, d, o in found), key=str)


def made(n=300, scale=1.0):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64)) * scale
    return [(i, [float(e) for e in centres[i % 6] + rng.normal(size=64) * 0.2 * scale]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, x string, cluster string, data int"


def run(spark, rows, **more):
    return sorted((tuple(r) for r in c.cluster(spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA), **more).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_curve_visits_neighbours_and_every_cell(bits):
    side, axes = 1 << bits, 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = c.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(side**axes))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_lose_no_nearest_centroid_and_rule_some_out():
    x = np.array([[math.floor(256 * e) for e in v] for _, v in made(600)], np.int64)
    curve = c.Curve.fit(x.astype(float))
    x = x[np.argsort(curve.keys(x), kind="stable")]
    cents = np.stack([x[i::6].mean(axis=0).astype(np.int64) for i in range(3)] + [x[i] for i in range(0, 600, 60)])
    seen = 0
    for at in range(0, 600, 20):
        own = x[at : at + 20]
        turned = own @ curve.axes
        able = c.candidates(turned.min(axis=0), turned.max(axis=0), cents @ curve.axes)
        want = ((own[:, None] - cents[None]) ** 2).sum(axis=2)
        assert set(want.argmin(axis=1)) <= set(able.tolist())
        seen += len(able)
    assert seen < 30 * len(cents)


@pytest.mark.parametrize(("size", "k"), [(256, 40), (7, 5), (1, 400)])
def test_equals_brute_force(spark, size, k):
    rows = made(120)
    assert run(spark, rows, size=size, k=k) == brute(rows, k)


def test_odd_rows(spark):
    rows = made(30)
    odd = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 63 + [None]), (104, [0.5] * 63 + [float("nan")]), (105, [float("-inf")] * 64),
           (None, [0.25] * 64), (None, [-0.1] * 64), (5, [0.3] * 64), (5, [0.3] * 64), *[(200 + i, [0.7] * 64) for i in range(40)]]
    assert run(spark, rows + odd) == brute(rows + odd)
    assert run(spark, []) == [] and run(spark, odd[:6]) == []
    assert c.cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_numbers_are_exact_and_huge_ones_bounded(spark):
    rows = made(40, 3e4)
    assert run(spark, rows, k=7) == brute(rows, 7)
    found = run(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], k=2, rounds=0)
    assert max(r[2] for r in found) <= 64 * (1 << 28) ** 2
