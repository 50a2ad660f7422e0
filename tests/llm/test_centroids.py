"""Clustering against plain numpy over all centroids; odd rows; what screening spares."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from strandline.llm import centroids as C

KIND = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    """rows: (vec_id, integers). (vec_id, cluster, distance), centroids."""
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    cs = [list(v) for _, v in start]
    for last in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs)) for _, v in rows]
        if last == rounds:
            return [(i, n, d) for (i, _), (d, n) in zip(rows, found, strict=True)], cs
        for n in range(len(cs)):
            mine = [v for (_, v), (_, m) in zip(rows, found, strict=True) if m == n]
            if mine:
                cs[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]


def whole(vector):
    return [int(np.floor(64 * float(np.float32(x)))) for x in vector]


def test_odd_rows_and_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 64)).tolist()
    bad = [(900, None), (901, []), (902, v[0][:63]), (903, [*v[0], 1.0]), (904, [None, *v[0][1:]]), (905, [float("nan"), *v[0][1:]]), (906, [float("-inf"), *v[0][1:]])]
    good = [*enumerate(v), (7, v[7]), (None, v[3]), *[(1000 + i, v[5]) for i in range(100)], (2000, [0.0] * 64)]
    df = spark.createDataFrame([(i, x, "clash", None) for i, x in [*good, *bad]], KIND)
    made = C.cluster(df).collect()
    want, cs = brute([(i, whole(x)) for i, x in good])
    key = lambda x: (x[0] is None, *[-1 if y is None else y for y in x])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in made), key=key) == sorted(want, key=key)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    inertia = {n: sum(d for _, m, d in want if m == n) for n in range(16)}
    assert all(r.centroid_sha256 == shas[r.cluster] and r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) for r in made)


def test_few_and_none(spark):
    few = spark.createDataFrame([(1, [1.0] * 64, "", 1), (2, [2.0] * 64, "", 1)], KIND)
    assert sorted((r.vec_id, r.distance) for r in C.cluster(few).collect()) == [(1, 0), (2, 0)]
    assert C.cluster(few.limit(0)).count() == 0 and C.cluster(few.limit(0)).columns == C.cluster(few).columns
    with pytest.raises(ValueError):
        C.cluster(spark.createDataFrame([(None, [1.0] * 64, "", 1)], KIND))
    with pytest.raises(Exception, match="too large"):
        C.cluster(spark.createDataFrame([(1, [3e30] * 64, "", 1)], KIND)).collect()


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    middles = rng.integers(-500, 500, (40, 64))
    v = middles[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 64))
    a, b = C.block_norms(v[:200].astype(float)), C.block_norms(middles.astype(float))
    bound = ((a[:, None] - b) ** 2).sum(axis=2)
    true = ((v[:200, None] - middles) ** 2).sum(axis=2)
    assert (bound <= true * (1 + 1e-12)).all()
    number, best, measured = C.nearest(v, C.block_norms(v.astype(float)), middles)
    all_ = ((v[:, None] - middles) ** 2).sum(axis=2)
    assert (best == all_.min(axis=1)).all() and (number == all_.argmin(axis=1)).all()
    assert measured.mean() < 2  # of 40


def test_ties_go_to_the_smaller_number():
    v = np.zeros((1, 64), np.int64)
    cs = np.array([np.eye(64, dtype=np.int64)[i] * s for i, s in ((5, 3), (9, -3), (1, 3), (0, 4))])
    assert [x.tolist() for x in C.nearest(v, C.block_norms(v.astype(float)), cs)[:2]] == [[0], [9]]
