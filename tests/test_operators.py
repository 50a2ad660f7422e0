"""Small fixtures with results derived by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.functions.schema import canonical_columns, canonical_name
from strandline.operators import align as A
from strandline.operators import govern as G
from strandline.operators import quality as Q
from strandline.operators import store as S
from strandline.operators import truth as T
from strandline.operators import windows as W
from strandline.operators.matching import fuzzy_tokens, match_schemas


def rel(spark, rows, schema="equipment_id string, start_ms double, end_ms double, work_order string"):
    return spark.createDataFrame(rows, schema)


def test_align_prefers_the_narrow_window(spark):
    seq = spark.createDataFrame([(0, "CNC-01", "500"), (1, "CNC-01", "bad"), (2, None, "500"), (3, "X", "500"), (4, "cnc 01", "5000")], "source_index int, machine_id string, ts string")
    r = rel(spark, [("CNC-01", 0.0, 1000.0, "broad"), ("CNC-01", 495.0, 505.0, "precise"), ("CNC-01", 9.0, 1.0, "reversed"), (None, 1.0, 2.0, "none")])
    got = {x.source_index: x for x in A.align(seq, r).collect()}
    assert got[0].relation.work_order == "precise" and got[0].alignment_distance_ms == 0 and got[0].invalid_relation_count == 2
    assert [got[i].alignment_reason for i in range(5)] == ["hit", "bad timestamp", "missing entity", "entity not found", "outside tolerance"]
    assert not got[1].aligned and got[4].entity_match == "exact"


def test_align_alias_keys(spark):
    seq = spark.createDataFrame([("CNC-01", 1000, 42.0)], "`机床编号` string, `采集时间` long, `测量值` double")
    r = spark.createDataFrame([("CNC-01", 0, 2000, "BROAD"), ("CNC-01", 990, 1010, "PRECISE")], "device_id string, `开始时间` long, `结束时间` long, work_order string")
    row = A.align(seq, r, 0.0).first()
    assert row.relation.work_order == "PRECISE" and row.alignment_distance_ms == 0 and row.value == 42.0


def test_align_fuzzy_entity_and_ties(spark):
    seq = spark.createDataFrame([(0, "pump-0001x", 10.0), (1, "pmp", 10.0)], "source_index int, equipment_id string, timestamp_ms double")
    r = rel(spark, [("pump-0001", 0.0, 20.0, "10"), ("pump-0001", 0.0, 20.0, "9")])
    got = {x.source_index: x for x in A.align(seq, r).collect()}
    assert got[0].entity_match == "fuzzy" and got[0].relation.work_order == "10"  # as text '10' < '9'
    assert got[1].entity_match == "none" and not got[1].aligned
    assert A.align(seq, r.limit(0)).where("aligned").count() == 0
    with pytest.raises(ValueError):
        A.align(seq, r, -1.0)
    with pytest.raises(ValueError):
        A.align(seq, r, 1.0, 1.5)


def test_align_bounds_are_closed(spark):
    seq = spark.createDataFrame([(i, "a", t) for i, t in enumerate([99.0, 100.0, 200.0, 201.0])], "source_index int, equipment_id string, timestamp_ms double")
    for bucket in (None, 7.0, 1e6):
        got = A.align(seq, rel(spark, [("A", 100.0, 200.0, "w")]), 0.0, bucket_ms=bucket).orderBy("source_index").collect()
        assert [x.aligned for x in got] == [False, True, True, False]


def test_fuse_keeps_unmatched(spark):
    seq = spark.createDataFrame([(0, "a", 5.0), (1, "a", 5e6)], "source_index int, equipment_id string, timestamp_ms double")
    got = A.fuse(seq, rel(spark, [("a", 0.0, 10.0, "w")]), 0.0).orderBy("source_index").collect()
    assert [x.relation_work_order for x in got] == ["w", None] and not got[1].aligned


def test_overlapping_labels_are_an_error(spark):
    rows = spark.createDataFrame([(5,)], "timestamp_ms long")
    one = spark.createDataFrame([(0, 10, "a")], "start_ms long, end_ms long, work_order string")
    assert A.label_by_interval(rows, one).first().label == "a"
    two = one.unionByName(spark.createDataFrame([(5, 9, "b")], one.schema))
    with pytest.raises(Exception, match="overlap"):
        A.label_by_interval(rows, two).collect()


RECORD = "source_index int, timestamp_ms double, equipment_id string, value double"


def test_timeliness(spark):
    row = Q.evaluate(spark.createDataFrame([(0, 1.0, "CNC-01", 42.0)], RECORD), 10_000.0, 100.0).first()
    assert row.timeliness == 0 and row.completeness == 100 and row.validity == 100


def test_consistency_compares_with_the_row_before(spark):
    rows = [(0, 10.0, "a", 1.0), (1, 5.0, "a", 1.0), (2, 7.0, "a", 1.0), (3, 6.0, "a", None), (4, 6.5, "b", 1.0)]
    row = Q.quality_counts(spark.createDataFrame(rows, RECORD), 0.0).first()
    assert (row.n, row.complete, row.consistent) == (5, 4, 3)


def test_text_values_and_specials(spark):
    rows = [(0, "1", "a", "nan"), (1, "2", "a", "1e999"), (2, "x", "a", "1"), (3, "3", "", "2e6"), (4, "inf", "a", "1")]
    row = Q.quality_counts(spark.createDataFrame(rows, "source_index int, timestamp_ms string, equipment_id string, value string"), 2.0, 1.0).first()
    assert (row.complete, row.consistent, row.timely, row.valid) == (4, 3, 2, 0)


def test_referential_and_stability(spark):
    df = spark.createDataFrame([(0, 1.0, "CNC-01", 1.0, "WO-1"), (1, 2.0, "UNKNOWN", 1.0, "WO-1")], RECORD + ", work_order string")
    master = {"equipment_id": spark.createDataFrame([("CNC-01",)], "v string"), "work_order": spark.createDataFrame([("WO-1",)], "v string")}
    row = Q.assess(df, master, 10.0).first()
    assert row.referential_integrity == 75.0 and row.referential_checks == 4
    s = Q.stability_counts(spark.createDataFrame([(i, 1.0, "a", v) for i, v in enumerate([1.0, 1.0, 1.0, 100.0])], RECORD)).first()
    assert (s.checked, s.stable) == (4, 3)


def test_assess_nothing(spark):
    row = Q.assess(spark.createDataFrame([], RECORD), {"equipment_id": spark.createDataFrame([("a",)], "v string")}, 0.0).first()
    assert all(row[d] == 0.0 for d in (*Q.DIMENSIONS, "uniqueness", "referential_integrity", "stability", "overall", "minimum"))


def test_rollup_skips_what_is_missing(spark):
    a = spark.createDataFrame([(95.0, 100.0)], "x double, y double")
    b = spark.createDataFrame([(99.0, None)], "x double, y double")
    row = Q.rollup_minimum([a, b], ("x", "y")).first()
    assert (row.x, row.y, row.overall, row.minimum) == (95.0, 100.0, 97.5, 95.0)


def test_govern(spark):
    rows = [(0, " cnc-01 ", "1767225600000", "42.1"), (1, "CNC-01", "bad", "42.2"), (2, " cnc-01 ", "1767225600000", "42.1"), (3, "CNC-02", "2026-01-01T00:00:00Z", " 7 "), (4, "", None, "")]
    df = spark.createDataFrame(rows, "source_index int, machine_id string, time string, value string")
    made = {r.source_index: r for r in G.govern(df).collect()}
    assert [made[i].status for i in range(5)] == ["accepted", "quarantined", "quarantined", "accepted", "quarantined"]
    assert made[2].reasons == ["duplicate"] and made[1].reasons == ["timestamp_ms isn't a finite number"]
    assert made[4].reasons == ["missing equipment_id", "missing timestamp_ms", "missing value"]
    assert [(a.rule, a.field) for a in made[0].actions] == [("trim_strings", "equipment_id"), ("normalize_equipment_id", "equipment_id"), ("coerce_numeric_fields", "timestamp_ms"), ("coerce_numeric_fields", "value")]
    assert made[3].timestamp_ms == 1767225600000.0 and made[0].equipment_id == "CNC-01"
    s = G.summary(G.govern(df)).first()
    assert (s.input_records, s.accepted_records, s.quarantined_records, s.repaired_records) == (5, 2, 3, 2)
    listed = G.govern(df, {"enforce_equipment_master": True}, spark.createDataFrame([("CNC-02",)], "v string"))
    assert [r.source_index for r in G.accepted(listed).collect()] == [3]
    both = {r.phase: r for r in G.before_and_after(df, G.govern(df), {"equipment_id": spark.createDataFrame([("CNC-01",)], "v string")}, 1767225600000.0).collect()}
    assert both["before"].validity < 100 and both["after"].validity == 100
    for bad in ({"unknown": True}, {"trim_strings": 1}):
        with pytest.raises(ValueError):
            G.Rules.of(bad)


def test_window_quality(spark):
    df = spark.createDataFrame([(0, 1.0, "CNC-01", 1.0), (1, 1500.0, "CNC-01", 1.0), (2, 1200.0, "CNC-01", 1.0), (3, None, "a", 1.0), (4, -5.0, "a", 1.0)], RECORD)
    got = {r.window_start_ms: r for r in W.window_quality(df, 1000.0).collect()}
    assert got[0.0].validity == 100 and got[1000.0].n == 2 and got[1000.0].consistency == 50 and got[None].n == 2


def test_ordered_rows(spark):
    df = spark.createDataFrame([(i, i * i, "ab"[i % 2]) for i in range(10)], "i int, v long, k string")
    assert [r.i for r in W.newest(df, 3, ["i"]).collect()] == [7, 8, 9]
    assert [r.i for r in W.first_in_bucket(df, F.floor(F.col("i") / 4), ["i"]).orderBy("i").collect()] == [0, 4, 8]
    assert [r.d2 for r in W.differences(df.where("k = 'a'"), "v", "i", ["k"]).orderBy("i").collect()] == [None, None, 8, 8, 8]


def test_cells(spark):
    truth = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "tid int, x string, y string")
    dirty = spark.createDataFrame([(1, "a", ""), (2, None, "dx")], "tid int, x string, y string")
    made = T.compare_cells(dirty, T.as_cells(truth, "tid", "correct_val"), "tid")
    row = T.cell_accuracy(made).first()
    assert (row.cells, row.present, row.correct) == (4, 2, 1) and len(T.mismatches(made, "tid", 2).collect()) == 2


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "r double")
    row = T.throughput(df, "r").first()
    assert (row.median, row.minimum, row.maximum) == (2.5, 1.0, 10.0) and row.cv == pytest.approx(4.08248 / 4, abs=1e-3)
    assert T.ratio_spread(df, "r").first().upper_median == 3.0
    low, high = V.wilson(F.lit(1000), F.lit(1000))
    w = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert w.a == pytest.approx(99.617, abs=1e-3) and w.b == 100


def test_scalars(spark):
    texts = ["1d", "0x1p3", "1_000", " 42.5 ", "NaN", "inf", "", None, "1e3", "-.5"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(V.finite(F.col("t"), "string").alias("v")).collect()]
    assert got == [None, None, None, 42.5, None, None, None, None, 1000.0, -0.5]
    z = spark.createDataFrame([(x,) for x in (0, -1, 1, 2**63 - 1, -(2**63))], "x long").select("x", V.unzigzag(V.zigzag(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in z)
    assert canonical_name(" TIME ") == "timestamp_ms" and canonical_name("Other ") == "other"
    assert canonical_columns(spark.createDataFrame([(1, 2, 3)], "ts int, other int, time int")).first().asDict() == {"timestamp_ms": 3, "other": 2}
    assert V.private_name(" ../a b? ") == "_a_b_" and V.private_name("..") == "data"


def test_matching(spark):
    known = spark.createDataFrame([("abcdefgh",), ("abcdefgx",), ("zz",), ("",)], "token string")
    wanted = spark.createDataFrame([("abcdefg",), ("zz",), ("qqqq",), ("",)], "token string")
    got = sorted((r.token, r.match) for r in fuzzy_tokens(wanted, known).collect())
    assert got == [("abcdefg", "abcdefgh"), ("abcdefg", "abcdefgx")]
    made = match_schemas(["机床编号", "采集时间", "???"], ["equipment_id", "timestamp_ms"])
    assert [m["accepted"] for m in made] == [True, True, False] and made[0]["confidence"] == 1.0
    assert match_schemas([], ["a"]) == []


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'q"x'), (2, 2.5, "")], 'id int, v double, `a"b` string')
    S.store_sequence(df, str(tmp_path / "s"))
    back = S.read_sequence(spark, str(tmp_path / "s"), df.schema)
    assert S.differing(df, back).count() == 0 and S.checksum(df).first() == S.checksum(back).first()
    S.store_relation(df, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in S.read_relation(spark, str(tmp_path / "r")).collect()) == [("", "2", "2.5"), ('q"x', "1", "")]
    assert S.as_relation(spark.createDataFrame([], "x int").select()).columns == ["_empty"]


def test_case_clash():
    from strandline.functions.schema import case_clashes

    assert case_clashes(["Sensor", "sensor", "x"]) == ["sensor"]
