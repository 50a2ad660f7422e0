"""Alignment and labels where intervals crowd: swept tokens give the rows of lists, of SQL and of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import align as A
from strandline.operators import sweep
from strandline.plans import catalog

from .compare import connection, normal

SEQ = "source_index int, equipment_id string, timestamp_ms double"
REL = "equipment_id string, start_ms double, end_ms double, work_order string"


def brute(samples, relations, tolerance):
    out = {}
    for i, e, t in samples:
        found = []
        for f, a, z, w in relations:
            if f == e and a is not None and z >= a:
                d = 0.0 if a <= t <= z else min(abs(t - a), abs(t - z))
                if d <= tolerance:
                    found.append((d, z - a, abs(t - (a + z) / 2), w))
        out[i] = min(found) if found else None
    return out


@pytest.mark.parametrize(("crowd", "seed"), [(0, 1), (3, 2), (10**6, 3)])
def test_swept_equals_all_pairs(spark, crowd, seed):
    """Ties of width, centre, ends and starts; points; a very long one; gaps; samples on ends."""
    rng = random.Random(seed)
    relations = [(rng.choice("abc"), float(a := rng.randrange(0, 300)), float(a + rng.choice([0, 0, 4, 4, 10, 10, 10, 37, 60])), f"{rng.randrange(10**6)}-{k}") for k in range(250)]
    relations += [("a", -1e6, 1e6, "long"), ("b", 500.0, 510.0, "late"), ("c", 5.0, 1.0, "reversed"), ("d", 40.0, 50.0, "alone")]
    samples = [(k, rng.choice("abcdx"), rng.randrange(-60, 1400) / 2) for k in range(1500)] + [(1500, "d", None), (1501, None, 5.0)]
    named = spark.createDataFrame(samples, SEQ).withColumns({"t": F.lit("mine"), "token": F.lit("too"), "event": F.lit(1)})  # names that the sweep uses itself
    made = A.align(named, spark.createDataFrame(relations, REL), 9.0, None, crowd=crowd).collect()
    want = brute(samples[:1500], relations, 9.0)
    assert len(made) == len(samples) and all((r.t, r.token, r.event) == ("mine", "too", 1) for r in made)
    for r in made:
        best = want.get(r.source_index)
        assert (r.relation.work_order if r.relation else None) == (best[3] if best else None), (r, best)
        assert r.alignment_distance_ms == (best[0] if best else None)
    reasons = {r.source_index: r.alignment_reason for r in made}
    assert reasons[1500] == "bad timestamp" and reasons[1501] == "missing entity"
    assert all(reasons[i] == "entity not found" for i, e, _ in samples if e == "x")


def test_a_crowded_hour(spark):
    """10^5 orders that cover one hour, and one very long order among short ones."""
    hour = spark.range(100_000).select(F.lit("m").alias("equipment_id"), (1000 - F.col("id") / 200).alias("start_ms"), (3_600_000 + F.col("id") * 2.0).alias("end_ms"), F.col("id").cast("string").alias("work_order"))
    short = spark.range(2000).select(F.lit("n").alias("equipment_id"), (F.col("id") * 1000.0).alias("start_ms"), (F.col("id") * 1000.0 + 10).alias("end_ms"), F.concat(F.lit("s"), "id").alias("work_order"))
    long_ = spark.createDataFrame([("n", -1e12, 1e12, "long")], short.schema)
    samples = spark.range(5000).select(F.col("id").alias("source_index"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("equipment_id"), (F.col("id") * 500.0 + 3000).alias("timestamp_ms"))
    got = {r.source_index: (r.relation.work_order, r.alignment_distance_ms) for r in A.align(samples, hour.unionByName(short).unionByName(long_), 0.0, None).collect()}
    assert all(got[i] == ("0", 0.0) for i in range(0, 5000, 2))
    for i in range(1, 5000, 2):
        t = i * 500 + 3000
        assert got[i] == ((f"s{t // 1000}", 0.0) if t % 1000 <= 10 and t < 2_000_000 else ("long", 0.0))


def test_best_sql_with_every_token_swept(spark, sf_dir):
    made = A.align(catalog.sequence(spark, sf_dir, True), catalog.relations(spark, sf_dir), catalog.HOUR, None, crowd=0)
    made = made.select("source_index", "aligned", F.col("relation.work_order").alias("work_order"), "alignment_distance_ms", "alignment_reason", "entity_match", "invalid_relation_count")
    found = connection(sf_dir).execute(catalog.ORACLE_SQL["align_best_window"])
    names = [d[0] for d in found.description]
    assert normal([tuple(r) for r in made.collect()], made.columns) == normal(found.fetchall(), names)


def test_asof(spark):
    rows = spark.createDataFrame([(k, k // 10, float(k % 10)) for k in range(40)], "i int, `k.` int, t double").withColumnRenamed("k.", "k")
    events = spark.createDataFrame([(0, 3.0, "a"), (0, 7.0, "b"), (1, 0.0, "c"), (3, 9.0, "d")], "k int, t double, event string")
    got = lambda **m: {r.i: r.e for r in sweep.asof(rows, events, "k", "t", "e", **m).collect()}
    table = {0: [(3, "a"), (7, "b")], 1: [(0, "c")], 2: [], 3: [(9, "d")]}
    for forward in (False, True):
        for strict in (False, True):
            made = got(forward=forward, strict=strict)
            for i in range(40):
                fit = [e for e in table[i // 10] if ((e[0] > i % 10) if forward else (e[0] < i % 10)) or (not strict and e[0] == i % 10)]
                assert made[i] == ((min if forward else max)(fit)[1] if fit else None)


def test_labels(spark):
    rng = random.Random(9)
    spans, at = [], 0
    for k in range(400):
        at += rng.randrange(1, 20)
        spans.append((at, at + rng.choice([0, 1, 5, 5000 if k == 200 else 3]), f"w{k}"))
        at = spans[-1][1]
    rows = spark.createDataFrame([(k, rng.randrange(-5, at + 20), "m") for k in range(1000)] + [(-1, None, "m")], "i int, timestamp_ms long, event string")
    kinds = "start_ms long, end_ms long, work_order string"
    odd = [(50, 10, "reversed"), (None, 5, "open"), (7, None, "open")]
    made = A.label_by_interval(rows, spark.createDataFrame([*spans, *odd], kinds)).collect()
    assert len(made) == 1001
    assert all(r.label == next((w for a, z, w in spans if r.timestamp_ms is not None and a <= r.timestamp_ms <= z), None) for r in made)
    for extra in [(spans[10][1], spans[10][1], "touch"), (spans[3][0] - 1, spans[300][0], "over many"), spans[5]]:
        with pytest.raises(ValueError, match="overlap"):
            A.label_by_interval(rows, spark.createDataFrame([*spans, extra], kinds))
    assert A.label_by_interval(rows, spark.createDataFrame([], kinds)).where("label IS NOT NULL").count() == 0
