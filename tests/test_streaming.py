"""The ring and its restart, replays with their ledger, consistency in event time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import ingest

SCHEMA = "i long, v double"


def put(spark, folder, *ids):
    spark.createDataFrame([(i, None if i % 5 == 0 else float(i)) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_ring_goes_on_after_a_restart(spark, tmp_path):
    put(spark, tmp_path / "in", *range(0, 40, 2))
    put(spark, tmp_path / "in", *range(1, 40, 2))
    ring = ingest.Ring(spark, str(tmp_path / "c"), SCHEMA, ["i"], capacity=12, max_batch=30, slots=3)
    ring.start(source(spark, tmp_path / "in")).awaitTermination()
    assert [r.i for r in ring.snapshot(99).collect()] == list(range(28, 40)) and ring.total() == 40
    again = ingest.Ring(spark, str(tmp_path / "c"), SCHEMA, ["i"], capacity=12, max_batch=30, slots=3)  # all it knows is in the checkpoint
    assert [(r.i, r.v) for r in again.snapshot(3).collect()] == [(37, 37.0), (38, 38.0), (39, 39.0)]
    put(spark, tmp_path / "in", 100, 5)
    again.start(source(spark, tmp_path / "in")).awaitTermination()
    assert [r.i for r in again.snapshot(12).collect()] == [*range(29, 40), 100] and again.total() == 42


def test_ring_refuses(spark, tmp_path):
    put(spark, tmp_path / "in", 1, 2, 3)
    ring = ingest.Ring(spark, str(tmp_path / "c"), SCHEMA, ["i"], capacity=2, max_batch=3, slots=1)
    ring.start(source(spark, tmp_path / "in")).awaitTermination()
    put(spark, tmp_path / "in", 4, 5, 6, 7)
    with pytest.raises(Exception, match="at most 3"):
        ring.start(source(spark, tmp_path / "in")).awaitTermination()
    assert [r.i for r in ring.snapshot(5).collect()] == [2, 3] and ring.total() == 3  # the state is that before the batch
    with pytest.raises(ValueError):
        ingest.Ring(spark, "x", SCHEMA, ["i"], capacity=0)


def test_replay_counts_what_is_lost(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path / "in", *range(k * 10, k * 10 + 10))

    def start(events, run):
        return events.writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()

    runs, ledger = ingest.replay(spark, lambda: source(spark, tmp_path / "in"), start, 31, repeats=2, warm_up=1)
    assert [(r.run, r.batches, r.rows, r.lost, r.gaps) for r in runs.orderBy("run").collect()] == [(0, 3, 30, 1, 0), (1, 3, 30, 1, 0)]
    assert [(r.run, r.batch, r.rows) for r in ledger.orderBy("run", "batch").collect()] == [(run, b, 10) for run in range(2) for b in range(3)]


def test_running_consistency_in_event_time(spark, tmp_path):
    """Shuffled arrival gives the counts of a lag over event time; what waits behind the watermark isn't counted yet, what comes too late is dropped."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 10**6 + k * 1000, rng.choice([None, *range(20)])) for k in range(300)]
    kind = "equipment_id string, at long, timestamp_ms double"
    order = list(range(300))
    for k in range(0, 300, 20):
        part = order[k : k + 20]
        rng.shuffle(part)
        order[k : k + 20] = part
    for k in range(0, 300, 50):
        spark.createDataFrame([(e, at, None if t is None else float(t)) for e, at, t in (rows[i] for i in order[k : k + 50])], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = ("a", 10**6, 5.0)
    end = ("end", 10**9, 1.0)
    for one in ([end], [late]):
        spark.createDataFrame(one, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = source(spark, tmp_path / "in", kind).withColumn("ts", F.timestamp_millis("at"))
    with ingest.rocksdb(spark):
        made = ingest.running_consistency(events, "ts", late="60 seconds")
        query = made.writeStream.outputMode("update").format("memory").queryName("consistency").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {}
    for r in spark.table("consistency").collect():
        got[r.equipment_id] = max(got.get(r.equipment_id, (0, 0)), (r.n, r.consistent))
    for e in ("a", "b", None):
        times = [t for x, _, t in rows if x == e and t is not None]
        assert got[e] == (len(times), sum(b >= a for a, b in zip(times, times[1:], strict=False)) + 1)
    assert "end" not in got


def test_state_is_asked_for_slots_not_for_entities():
    """What 200 entities bring a slot is one element of its state; it comes due in parts, in the order of time and place."""
    import pandas as pd

    asked = []

    class Held(list):
        def __getattr__(self, name):
            def call(*a):
                asked.append(name)
                return {"appendValue": lambda: self.append(a[0]), "get": lambda: iter(self), "clear": self.clear, "put": lambda: self.__setitem__(slice(None), a[0]), "exists": lambda: bool(self), "update": lambda: self.__setitem__(slice(None), a)}[name]()
            return call

        def clear(self):
            del self[:]

    class One(Held):
        def __getattr__(self, name):
            return (lambda: self[0]) if name == "get" else super().__getattr__(name)

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    timers = []
    own = ingest._Ordered()
    own.waiting, own.counts, own.handle = Held(), One(), type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    rows = [(0, f"=e{i % 200}", 100 + i // 200, 0, float(i // 200 % 3)) for i in range(2000)]
    assert list(own.handleInputRows((0,), iter([pd.DataFrame(rows)]), None)) == []
    assert asked == ["appendValue"] and timers == [100]
    first, = own.handleExpiredTimer((0,), Clock(104), None)
    then, = own.handleExpiredTimer((0,), Clock(999), None)
    assert {*first.itertuples(index=False, name=None)} == {(f"=e{i}", 5, 4) for i in range(200)}
    assert {*then.itertuples(index=False, name=None)} == {(f"=e{i}", 10, 7) for i in range(200)}
    assert timers == [100, 105] and not own.waiting and list(own.handleExpiredTimer((0,), Clock(999), None)) == []
