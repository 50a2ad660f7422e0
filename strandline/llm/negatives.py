"""Hard negatives by one-dimensional distance keys: vectors sorted by (pivot, distance), searched in annuli that grow until what is left can't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

#: Steps of a component's unit; components of that size or more are an error, as 100 scores of 64 of them would not fit 64 bits.
SCALE, LARGEST = 256, 1 << 25
#: Anchors are the rows whose vec_id it divides; where the second divides it, the label is taken for wrong.
ANCHORS, NOISY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, as percentages of the positive's.
BAND = (30, 90)
#: Pivots, the rows they and the first radii are taken from, rows of a stored block, queries that meet a block at once.
PIVOTS, SAMPLE, ROWS, QUERIES = 32, 2048, 2048, 1024
#: Rows of the kind asked for that the first annuli hold, about, as multiples of those wanted; then all that is left.
REACH = (4, 32)


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): usable rows as integers floor(256 * x), the label after noise; a vec_id that repeats is one row, that of the smallest label, then vector."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = SCALE * x.cast("double")
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")).cast("int")

    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & fine)
    label = F.when(F.col("vec_id") % NOISY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("int").alias("label"), F.transform(e, whole).alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.float64)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    """v with a component more, so that all have the squared length `top` and the largest inner product is the least distance."""
    return np.concatenate((v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0.0))[:, None]), axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T), 0.0))


class Index:
    """Vectors in blocks of at most ROWS, sorted by (pivot, distance to it, vec_id), each with the bounds of its distances.

    Pivots are the means that a few rounds of k-means find in SAMPLE vectors, those with the smallest hashes of their ids; every vector is stored.
    Equal vectors have equal keys but different ids, so they fill as many blocks as they need.
    """

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = ROWS) -> None:
        self.width = width = max(rows.agg(F.max(F.size("v"))).first()[0], 1)
        filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column("v").flatten(), dtype="<i4").reshape(-1, width)
                squares = (v.astype(np.int64) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(squares)], ["vec_id", "label", "v", "squares"])

        self.rows = written(rows.select("vec_id", "label", filled.alias("v")).mapInArrow(pack, "vec_id bigint, label int, v binary, squares bigint"), "vectors")
        top = self.top = float(self.rows.agg(F.max("squares")).first()[0])
        seen = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("label", "v").toArrow()
        self.sample = _matrix(seen.column("v"), width), seen.column("label").to_numpy()
        self.pivots = found = _pivots(_lifted(self.sample[0], top), pivots)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(_lifted(_matrix(batch.column("v"), width), top), found)
                    near = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "v")], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "label", "v", "pivot", "key"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) >= 4 * block:
                    whole = pa.concat_tables(held).combine_chunks()
                    done, rest = _cut(whole, block, False)
                    held = [rest]
                    yield done
            if held:
                yield _cut(pa.concat_tables(held).combine_chunks(), block, True)[0]

        stored = "pivot int, low double, high double, ids binary, labels binary, vectors binary"
        ordered = self.rows.mapInArrow(keyed, "vec_id bigint, label int, v binary, pivot int, key double")
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        ordered = ordered.repartitionByRange(parts, "pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
        blocks = ordered.mapInArrow(cut, stored).withColumn("block", F.monotonically_increasing_id())
        self.blocks = written(blocks, "blocks")

    def search(self, asked: DataFrame) -> DataFrame:
        """(ask, vec_id, score, place) of what `asked` wants; asked: ask, anchor, label, v, same, low, high, wanted.

        Of the other rows with the same label as the anchor's (same), or with another, and a score from low to high, the `wanted` first: the larger
        score, then the smaller vec_id. Each round scans, for each question not certified yet, the blocks whose keys meet a
        wider annulus around it and that no earlier round read: first to the radius at which the sample promises REACH[0] times the rows wanted, then REACH[1] times,
        then to the bound `low`, where nothing can be left. A question is certified when its last row scores more than all that lies outside can.
        """
        width, top, pivots, (known, labels) = self.width, self.top, self.pivots, self.sample
        asked = self._placed(asked)
        open_, found = asked, None
        directory = self.blocks.select("block", "pivot", F.col("low").alias("key_low"), F.col("high").alias("key_high"))
        for i in range(len(REACH) + 1):
            near = F.col(f"radius{i}")
            before = F.col(f"radius{i - 1}") if i else F.col("inner")
            each = open_.select("ask", F.posexplode("distances").alias("pivot", "d"), "inner", *dict.fromkeys([f"radius{i}", f"radius{max(i - 1, 0)}"]))
            low = F.greatest(F.col("d") - F.col("key_high"), F.col("key_low") - F.col("d"), F.lit(0.0))  # no row of the block is nearer
            high = F.col("d") + F.col("key_high")  # none is farther
            new = (low <= near) & (high >= F.col("inner")) & ((low > before) if i else F.lit(True))
            pairs = each.join(directory, "pivot").where(new).select("ask", "block")
            more = written(self._scored(pairs, open_), "found")
            found = more if found is None else found.unionByName(more)
            rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
            found = written(found.withColumn("place", rank.cast("int")).where(F.col("place") <= F.col("wanted")).drop("place"), "nearest")
            if i == len(REACH):
                break
            held = found.groupBy("ask").agg(F.count("*").alias("held"), F.min("score").alias("least"))
            met = open_.join(held, "ask", "left")
            # a row outside the radius has a squared distance above radius^2, so a score below this
            outside = (F.col("squares") + top - near * near) / 2 + 1e-6 * (F.col("squares") + top)
            sure = (F.coalesce("held", F.lit(0)) >= F.col("wanted")) & (F.col("least") > outside)
            open_ = written(met.where(~F.coalesce(sure, F.lit(False)) & (near < F.col(f"radius{len(REACH)}"))).select(*asked.columns), "open")
            if open_.isEmpty():
                break
        return found.select("ask", "vec_id", "score", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")).alias("place"))

    def _placed(self, asked: DataFrame) -> DataFrame:
        """asked with squares, its distances from all pivots, the radius within which all score too much (inner) and the radii of the rounds."""
        width, top, pivots, (known, labels) = self.width, self.top, self.pivots, self.sample

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("v"), width)
                squares = (q**2).sum(axis=1)
                d = _distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1), pivots)
                told = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "same", "low", "high", "wanted")}
                scores = q @ known.T
                slack = 1e-6 * (squares + top) + 1.0  # wider than rounding
                radius = lambda s: np.sqrt(np.maximum(squares + top - 2 * np.asarray(s, float) + slack, 0.0))
                last = radius(told["low"])
                rounds = []
                for reach in REACH:
                    at = np.empty(len(q))
                    for i in range(len(q)):
                        kind = (labels == told["label"][i]) == told["same"][i]
                        mine = np.sort(scores[i][kind & (scores[i] <= told["high"][i])])[::-1]
                        share = min(len(mine), int(np.ceil(reach * told["wanted"][i] * len(known) / self_rows)))
                        at[i] = mine[share - 1] if share else told["low"][i]
                    rounds.append(np.minimum(radius(at), last))
                inner = np.sqrt(np.maximum(squares + top - 2 * told["high"] - slack, 0.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(squares), pa.array(list(d), pa.list_(pa.float64())), pa.array(inner), *[pa.array(r) for r in (*rounds, last)]], [*batch.schema.names, "squares", "distances", "inner", *[f"radius{i}" for i in range(len(rounds) + 1)]])

        self_rows = max(self.rows.count(), 1)
        radii = ", ".join(f"radius{i} double" for i in range(len(REACH) + 1))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return written(asked.mapInArrow(place, f"{kinds}, squares double, distances array<double>, inner double, {radii}"), "asked")

    def _scored(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(ask, wanted, vec_id, score): of each pair of question and block the first rows wanted. A task holds one block and QUERIES questions, about."""
        width = self.width
        decks = -(-max(asked.count(), 1) // QUERIES)
        deck = F.pmod(F.xxhash64("ask"), F.lit(decks))
        questions = pairs.join(asked.select("ask", "anchor", "label", "v", "same", "low", "high", "wanted"), "ask").withColumn("deck", deck)
        needed = pairs.select(F.col("block").alias("read"), deck.alias("by")).distinct()
        stored = needed.join(self.blocks.select(F.col("block").alias("read"), "ids", "labels", "vectors"), "read")

        def score(key: tuple, ask: pa.Table, have: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if ask.num_rows and have.num_rows:
                ids = np.frombuffer(have.column("ids")[0].as_py(), "<i8")
                kinds = np.frombuffer(have.column("labels")[0].as_py(), "<i4")
                v = np.frombuffer(have.column("vectors")[0].as_py(), "<i4").reshape(-1, width)
                order = np.argsort(ids)  # so that a stable sort by score breaks ties by id
                ids, kinds, v = ids[order], kinds[order], v[order]
                anchors, where = np.unique(ask.column("anchor").to_numpy(), return_index=True)
                one = np.searchsorted(anchors, ask.column("anchor").to_numpy())
                q = np.frombuffer(b"".join(x.as_py() for x in ask.column("v").take(pa.array(where))), "<i4").reshape(-1, width)
                # whole numbers in double precision are exact below 2^53
                big = float(np.sqrt((q.astype(float) ** 2).sum(axis=1).max(initial=0) * (v.astype(float) ** 2).sum(axis=1).max(initial=0))) >= 2.0**52
                scores = q.astype(object if big else float) @ v.T.astype(object if big else float)
                told = {c: ask.column(c).to_numpy() for c in ("ask", "anchor", "label", "same", "low", "high", "wanted")}
                for i in range(len(one)):
                    s = scores[one[i]]
                    fits = np.flatnonzero(((kinds == told["label"][i]) == told["same"][i]) & (ids != told["anchor"][i]) & (s >= told["low"][i]) & (s <= told["high"][i]))
                    if len(fits):
                        best = fits[np.argsort(-s[fits].astype(np.int64), kind="stable")[: told["wanted"][i]]]
                        out.append((np.full(len(best), told["ask"][i]), np.full(len(best), told["wanted"][i]), ids[best], s[best].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            kind = pa.schema([("ask", pa.int64()), ("wanted", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
            return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        return questions.groupBy("block", "deck").cogroup(stored.groupBy("read", "by")).applyInArrow(score, "ask bigint, wanted int, vec_id bigint, score bigint")


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(4):
        near = _distances(x, centres).argmin(axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def _cut(rows: pa.Table, block: int, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
    """Blocks of sorted rows, none across pivots, and the rows that may yet be joined by others."""
    pivot, key = rows.column("pivot").to_numpy(), rows.column("key").to_numpy()
    out, at = [], 0
    while at < len(pivot):
        end = min(int(np.searchsorted(pivot, pivot[at], side="right")), at + block)
        if end == len(pivot) and end - at < block and not last:
            break
        part = rows.slice(at, end - at)
        out.append((int(pivot[at]), float(key[at]), float(key[end - 1]), part.column("vec_id").to_numpy().astype("<i8").tobytes(), part.column("label").to_numpy().astype("<i4").tobytes(), b"".join(part.column("v").to_pylist())))
        at = end
    kind = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind), rows.slice(at)


def mine(vectors: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, **index) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of other labels that are near an anchor, but less than its positive.

    Anchors are rows whose vec_id `anchors` divides; positives its first rows of the same label by integer inner product, larger first, ties by smaller vec_id.
    Negatives are the first rows of another label with 100 times their score between band[0] and band[1] times the positive's. An anchor without
    positives, or a positive without negatives, gives no row. Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; a vec_id that
    repeats is one row (see `prepared`); a dimension that one of two vectors lacks counts as 0; other columns are ignored; a component
    of 2^25 steps or more is an error. The search is exact at any size: it ends for a question when the annuli scanned certify its rows.
    """
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = written(prepared(vectors), "usable")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], kind)
    made = Index(rows, **index)
    anchor = made.rows.where(F.col("vec_id") % anchors == 0).select(F.col("vec_id").alias("anchor"), "label", "v")
    most = F.lit((1 << 62) - 1).cast("long")
    asked = anchor.select(F.col("anchor").alias("ask"), "anchor", "label", "v", F.lit(True).alias("same"), (-most).alias("low"), most.alias("high"), F.lit(positives).alias("wanted"))
    found = written(made.search(asked).select(F.col("ask").alias("anchor"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"), "place"), "positives")
    # whole scores s with band[0] * p <= 100 * s <= band[1] * p
    told = found.join(anchor, "anchor").withColumn("ask", F.monotonically_increasing_id())
    told = told.withColumn("low", F.ceil(F.col("positive_score") * band[0] / F.lit(100).cast("decimal(20,0)")).cast("long")).withColumn("high", F.floor(F.col("positive_score") * band[1] / F.lit(100).cast("decimal(20,0)")).cast("long"))
    told = written(told.where(F.col("low") <= F.col("high")).select("ask", "anchor", "label", "v", F.lit(False).alias("same"), "low", "high", F.lit(negatives).alias("wanted"), "positive", "positive_score"), "asked")
    if told.isEmpty():
        return vectors.sparkSession.createDataFrame([], kind)
    hard = made.search(told.drop("positive", "positive_score"))
    return hard.join(told.select("ask", "anchor", "positive", "positive_score"), "ask").select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
