"""Streams: a ring of the newest rows in keyed state, replays with a ledger of what was lost, windows of event time."""

from __future__ import annotations

import json
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from strandline.functions.values import quoted

#: The process that prepares keyed state gets only what is pickled, not the path of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY, MAX_BATCH = 250_000, 20_000
#: Keys over which a ring is dealt.
SLOTS = 8
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which state with lists and timers needs."""
    name, wanted = _PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Newest(StatefulProcessor):
    """Of each slot a list of rows, cut to the newest `capacity` whenever it has twice as many, and the number of all rows seen."""

    def __init__(self, schema: str, order: list[int], capacity: int, max_batch: int):
        self.schema, self.order, self.capacity, self.max_batch = schema, order, capacity, max_batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.seen = handle.getValueState("seen", "total bigint, held bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [tuple(r)[1:] for r in rows]  # without the slot
        if len(new) > self.max_batch:
            raise ValueError(f"a batch of {len(new)} rows; at most {self.max_batch} are taken")
        total, held = self.seen.get() if self.seen.exists() else (0, 0)
        if held + len(new) > 2 * self.capacity:
            every = [*(self.rows.get() if self.rows.exists() else []), *new]
            every.sort(key=lambda r: tuple((r[i] is not None, r[i]) if r[i] is not None else (False,) for i in self.order))
            every = [tuple(r) for r in every[-self.capacity :]]
            self.rows.put(every)
            held = len(every)
        elif new:
            self.rows.appendList(new)
            held += len(new)
        self.seen.update((total + len(new), held))
        yield Row(slot=key[0], total=total + len(new), held=held)

    def close(self) -> None:
        pass


class Ring:
    """The newest `capacity` rows of a stream, by `order`, kept in the state of the query that takes them; a restart from its checkpoint goes on with the same rows.

    Rows are dealt over `slots` by a hash of all columns; each keeps its own newest ones, so all that can be among the newest of all, and no task keeps more than twice the capacity.
    A batch that brings a slot more than max_batch rows is refused as a whole: the query fails and its state stays as it was. Snapshots read the state
    that the last finished batch left in the checkpoint, so any session that sees the folder can take one. Columns of maps or other types without an order can't be in `order`.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, schema: str, order: list[str], capacity: int = CAPACITY, max_batch: int = MAX_BATCH, slots: int = SLOTS):
        if capacity <= 0 or max_batch <= 0 or slots <= 0:
            raise ValueError("capacity, batch and slots must be positive")
        self.spark, self.checkpoint, self.schema, self.order, self.capacity, self.max_batch, self.slots = spark, checkpoint, schema, order, capacity, max_batch, slots
        self.columns = spark.createDataFrame([], schema).columns

    def stream(self, events: DataFrame) -> DataFrame:
        """A streaming frame (slot, total, held) that takes the rows."""
        kind = self.schema
        processor = _Newest(kind, [self.columns.index(c) for c in self.order], self.capacity, self.max_batch)
        dealt = events.select(F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in self.columns]), F.lit(self.slots)).alias("slot"), *[F.col(quoted(c)) for c in self.columns])
        return dealt.groupBy("slot").transformWithState(processor, "slot bigint, total bigint, held bigint", "Update", "None")

    def start(self, events: DataFrame) -> StreamingQuery:
        """Take all that is there, batch by batch, and stop."""
        with rocksdb(self.spark):
            return self.stream(events).writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def _state(self, name: str) -> DataFrame:
        with rocksdb(self.spark):
            return self.spark.read.format("statestore").option("stateVarName", name).load(self.checkpoint)

    def total(self) -> int:
        """Rows taken so far."""
        return self._state("seen").agg(F.sum("value.total")).first()[0] or 0

    def snapshot(self, limit: int) -> DataFrame:
        """The newest rows, oldest first."""
        rows = self._state("rows").select("list_element.*")
        return rows.orderBy(*[F.desc(c) for c in self.order]).limit(min(limit, self.capacity)).orderBy(*self.order)


class Ledger(StreamingQueryListener):
    """Of each batch of one query: its number, its rows, and the offsets from which and to which each source was read."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str, str, float]] = []
        self.ended = threading.Event()
        self.run: str | None = None
        self.waiting: list = []

    def follow(self, query: StreamingQuery) -> None:
        """From now on, and from what was heard before, only this query counts."""
        self.run = str(query.runId)
        for event in self.waiting:
            self._note(event)

    def _note(self, event: object) -> None:
        if self.run is None:
            self.waiting.append(event)
            return
        if hasattr(event, "progress"):
            p = event.progress
            if str(p.runId) == self.run and p.numInputRows:
                offsets = [json.dumps([getattr(s, k) for s in p.sources]) for k in ("startOffset", "endOffset")]
                self.rows.append((p.batchId, p.numInputRows, *offsets, p.batchDuration / 1000))
        elif str(event.runId) == self.run:
            self.ended.set()

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        self._note(event)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self._note(event)


LEDGER = "run int, batch bigint, rows bigint, start_offset string, end_offset string, seconds double"
RUNS = "run int, batches bigint, rows bigint, lost bigint, gaps bigint, seconds double, rows_per_second double"


def replay(spark: SparkSession, source: Callable[[], DataFrame], start: Callable[[DataFrame, int], StreamingQuery], expected: int, repeats: int = 1, warm_up: int = 0) -> tuple[DataFrame, DataFrame]:
    """(runs, ledger) of a stream that is run over all that is there, `repeats` times after `warm_up` runs that don't count.

    source makes the stream, start(frame, run) starts a query that ends by itself, with a checkpoint of its own for each run. expected: rows that the source holds.
    The ledger has a row for each batch, from the events of the query; a run's `lost` is expected less what its batches took (below 0: taken twice), its `gaps` are batches that don't begin at the
    offset at which the one before ended. Runs are few and a batch is one row, so both come from the driver.
    """
    batches, runs = [], []
    for run in range(-warm_up, repeats):
        ledger = Ledger()
        spark.streams.addListener(ledger)
        try:
            began = time.perf_counter()
            query = start(source(), run)
            ledger.follow(query)
            query.awaitTermination()
            seconds = time.perf_counter() - began
            if not ledger.ended.wait(60):
                raise TimeoutError("the events of the query didn't come")
        finally:
            spark.streams.removeListener(ledger)
        if run < 0:
            continue
        own = sorted(ledger.rows)
        taken = sum(r[1] for r in own)
        gaps = sum(a[3] != b[2] for a, b in zip(own, own[1:], strict=False))
        batches += [(run, *r) for r in own]
        runs.append((run, len(own), taken, expected - taken, gaps, seconds, taken / max(seconds, 1e-9)))
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(batches, LEDGER)


def window_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Rows, valid values and their sum of tumbling windows of event time; rows later than `late` behind the newest are left out."""
    valid = F.col(value).isNotNull() & F.col(value).between(-1e6, 1e6)
    made = events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.sum(value).alias("total"))
    return made.select(F.col("window.start").alias("window_start"), *by, "n", "valid", "total")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


_WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("t", pa.float64())])
_COUNTED = pa.schema([("key", pa.string()), ("n", pa.int64()), ("consistent", pa.int64()), ("last", pa.float64())])


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def _unpacked(values: Iterable[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(v[0])).read_all() for v in values]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


class _Ordered(StatefulProcessor):
    """Rows wait until no earlier one can come, then are compared in the order of their event time (and of `place` within one).

    A slot holds many entities. What a batch brings it are few packed elements of its list, so that state is asked a few times for each slot and batch, not for each row or entity.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.counts = handle.getValueState("counts", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for more in rows:
            new = more.iloc[:, 1:5].set_axis(_WAITING.names, axis=1)
            new = new[new["t"].notna()]
            if len(new):
                self.waiting.appendValue(_packed(new, _WAITING))
                self.handle.registerTimer(int(new["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        every = _unpacked(self.waiting.get(), _WAITING)
        due = every["at"] <= upto
        ready, rest = every[due].sort_values(["key", "at", "place", "t"]), every[~due]
        if not len(ready):
            return
        told = _unpacked([self.counts.get()] if self.counts.exists() else [], _COUNTED).set_index("key")
        of, t = ready["key"], ready["t"]
        before = t.shift().where(of == of.shift(), of.map(told["last"]))
        new = pd.DataFrame({"key": of, "n": 1, "consistent": (before.isna() | (t >= before)).astype("int64"), "last": t}).groupby("key").agg({"n": "sum", "consistent": "sum", "last": "last"})
        new[["n", "consistent"]] += told[["n", "consistent"]].reindex(new.index, fill_value=0)
        self.counts.update(_packed(pd.concat([told.drop(new.index, errors="ignore"), new]).reset_index(), _COUNTED))
        if len(rest):
            self.waiting.put([_packed(rest, _WAITING)])
            self.handle.registerTimer(int(rest["at"].min()))
        else:
            self.waiting.clear()
        yield new.reset_index()[["key", "n", "consistent"]]

    def close(self) -> None:
        pass


def running_consistency(events: DataFrame, ts: str, entity: str = "equipment_id", t: str = "timestamp_ms", place: str | None = None, late: str = "10 minutes", slots: int = 512) -> DataFrame:
    """(entity, n, consistent) as far as the watermark has come: rows whose `t` isn't before that of the row before them in event time `ts`, of each entity.

    Rows may arrive in any order within `late`: they wait in state, with a timer at the first event time, and are compared when the watermark passes it; rows that are later
    still are dropped, which the query's progress counts, and so are times of 1970 or before, where watermarks begin. place: a whole number that orders rows of one event time. Rows without a number `t` are neither counted nor compared; a null
    entity is one of its own. Entities are dealt over `slots` keys of the state, each of which a task reads whole when it comes due: raise them if more rows wait at once. Start the query within `rocksdb`, in update mode.
    """
    entity_text = F.coalesce(F.concat(F.lit("="), F.col(quoted(entity)).cast("string")), F.lit(""))  # a null entity is a text, too
    at = F.coalesce(F.col(quoted(place)).cast("long"), F.lit(-(1 << 63))) if place else F.lit(0).cast("long")
    told = events.withWatermark(ts, late).select(entity_text.alias("key"), F.unix_millis(F.col(quoted(ts))).alias("at"), at.alias("place"), F.col(quoted(t)).cast("double").alias("t"), F.col(quoted(ts)).alias("event_time"))
    dealt = told.select(F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"), "*")
    made = dealt.groupBy("slot").transformWithStateInPandas(_Ordered(), "key string, n bigint, consistent bigint", "Update", "EventTime")
    return made.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(events.schema[entity].dataType).alias(entity), "n", "consistent")
