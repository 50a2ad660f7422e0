"""Hard negatives against all pairs: clustered vectors whose annuli certify early, hot copies, ties, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from strandline.llm import negatives as N

KIND = "vec_id long, embedding array<float>, label int, place string, ask int"


def brute(rows, anchors=100, positives=5, negatives=10, band=(30, 90)):
    """rows: {vec_id: (label, integers)}; the result as tuples."""
    out, ids = [], sorted(rows)
    v = np.array([rows[i][1] for i in ids], dtype=object)
    label = np.array([rows[i][0] for i in ids])
    for n, a in enumerate(ids):
        if a % anchors:
            continue
        score = v @ v[n]
        order = sorted((i for i in range(len(ids)) if i != n), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if label[i] == label[n]][:positives]:
            hit = [i for i in order if label[i] != label[n] and band[0] * score[p] <= 100 * score[i] <= band[1] * score[p]][:negatives]
            out += [(a, ids[p], r + 1, ids[i], score[p], score[i]) for r, i in enumerate(hit)]
    return sorted(out)


def noisy(i, label):
    return (label + 1) % 10 if i % 7 == 0 else label


def whole(x):
    return [int(np.floor(256 * float(np.float32(c)))) for c in x]


def made(spark, rows, **more):
    df = spark.createDataFrame([(i, x, y, "clash", 0) for i, (y, x) in rows.items()], KIND)
    return sorted(map(tuple, N.mine(df, **more).collect()))


def test_clusters_and_copies(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16))
    rows = {}
    for i in range(3000):
        c = int(rng.integers(0, 20))
        x = middle[c] + 0.1 * rng.normal(size=16) if i % 3 else middle[0]  # a third are copies of one vector
        rows[i] = (int(rng.integers(0, 4)) if i % 3 else c % 4, [float(y) for y in x])
    want = brute({i: (noisy(i, y), whole(x)) for i, (y, x) in rows.items()})
    assert len(want) > 500
    assert made(spark, rows, block=64, pivots=12, sample=256) == want


def test_annuli_spare_blocks(spark):
    """Far clusters are never read for a question whose nearest ones certify it."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in 10 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)], i % 2, "", 0) for i in range(4000)], KIND)
    index = N.Index(N.prepared(rows), pivots=8, sample=512, block=50)
    seen = []
    scored = index._scored
    index._scored = lambda pairs, asked: seen.append(pairs.count()) or scored(pairs, asked)
    anchor = index.rows.where("vec_id % 100 = 0").selectExpr("vec_id AS ask", "vec_id AS anchor", "label", "v", "true AS same", "-4000000000000000000 AS low", "4000000000000000000 AS high", "3 AS wanted")
    assert index.search(anchor).count() == 3 * 40
    assert sum(seen) < 0.3 * 40 * index.blocks.count()


def test_signs_ties_and_small_numbers(spark):
    rng = np.random.default_rng(8)
    rows = {i: (int(rng.integers(0, 3)), [float(x) for x in rng.integers(-1, 2, 4) / 16]) for i in range(400)}
    rows[-100] = (1, [0.0] * 4)
    want = brute({i: (noisy(i, y), whole(x)) for i, (y, x) in rows.items()})
    assert made(spark, rows, block=16, pivots=4, sample=50) == want
    assert made(spark, rows, block=1000, pivots=1, sample=1) == want


def test_odd_rows(spark):
    good = [(i, [float(np.cos(i + k)) for k in range(6)], i % 2) for i in range(0, 300, 10)]
    odd = [(None, [1.0] * 6, 1), (1, None, 1), (2, [1.0] * 6, None), (3, [None, *[1.0] * 5], 1), (4, [float("nan")] * 6, 1), (5, [float("inf")] * 6, 1)]
    unlike = [(6, [], 1), (8, [1.0, 1.0], 0), (9, [1.0] * 9, 1)]
    df = spark.createDataFrame([(i, x, y, "p", 1) for i, x, y in [*good, *odd, *unlike, *good[:5]]], KIND)
    pad = lambda x: [*x, *[0] * (9 - len(x))]
    want = brute({i: (noisy(i, y), pad(whole(x))) for i, x, y in [*good, *unlike]})
    assert sorted(map(tuple, N.mine(df).collect())) == want and want
    assert N.mine(df.limit(0)).count() == 0 and N.mine(df.where("vec_id = 100")).count() == 0
    with pytest.raises(Exception, match="too large"):
        N.mine(spark.createDataFrame([(1, [3e30], 1, "", 1)], KIND)).collect()
