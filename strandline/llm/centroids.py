"""Clustering of integer vectors around centroids, with candidates screened by block norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import written

#: Centroids, rounds that move them, components of a vector, steps of a component's unit.
CENTROIDS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Components that share a norm.
SEGMENT = 8
#: Components beyond it are an error: squared distances of 64 of them would not fit 64 bits.
LARGEST = 1 << 27


def kept(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors with exactly `width` components, none null or not finite, as integers floor(scale * x)."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(scale * x.cast("double"))
        return F.when(F.abs(scale * x.cast("double")) < LARGEST, y).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")).cast("int")

    return vectors.where(e.isNotNull() & (F.size(e) == width) & fine).select("vec_id", F.transform(e, whole).alias("v"))


def block_norms(v: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The compressed vectors: for each segment the norm of its mean part and the norm of what is left, rows x 2 segments.

    Both parts of a segment are orthogonal, so by Cauchy-Schwarz in each the squared distance of two compressed vectors is at most that of the vectors.
    """
    n, width = v.shape
    segment = min(segment, width)
    padded = np.zeros((n, -(-width // segment) * segment))
    padded[:, :width] = v
    parts = padded.reshape(n, -1, segment)
    mean = parts.sum(axis=2) / np.sqrt(segment)  # with its sign: the distance of mean parts is exact
    rest = np.sqrt(np.maximum((parts**2).sum(axis=2) - mean**2, 0.0))
    return np.concatenate((mean, rest), axis=1)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, centroids measured) of each vector; ties go to the smaller number.

    The centroid whose compressed distance is least is measured first; of the others only those whose lower bound isn't above what was found.
    """
    short = block_norms(centroids)
    size = (norms**2).sum(axis=1)[:, None] + (short**2).sum(axis=1)
    low = size - 2 * (norms @ short.T) - 1e-9 * size - 1.0  # less than the true bound by more than rounding adds
    guess = low.argmin(axis=1)
    best = ((v - centroids[guess]) ** 2).sum(axis=1)
    number, measured = guess.copy(), np.ones(len(v), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= best) & (guess != c))
        d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
        measured[rows] += 1
        better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], c
    return number, best, measured


def _block(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
    return v, np.frombuffer(b"".join(batch.column("norms").to_pylist()), "<f8").reshape(len(v), -1)


def _first(rows: DataFrame, seed: str, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; vectors of one id in the order of their components."""
    picked = rows.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r.v for r in picked.collect()], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured): each kept vector with its centroid.

    Centroids start as the k vectors whose ids hash smallest (fewer, if there are fewer); each of `rounds` rounds assigns all vectors
    to the nearest and moves every centroid that has some to the floor of their exact mean; then all are assigned once more. Vectors that
    `kept` leaves out (null, another length, null or non-finite components) give no row. A null vec_id is clustered but starts
    no centroid; rows that repeat count as often as they stand there; other columns are ignored; without vectors there are no rows.
    A component of 2^27 steps or more is an error. Only the k centroids, and their sums from each task, reach the driver. measured: how many centroids were held against
    the vector exactly, the others being ruled out by block norms.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, width, scale)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("v").flatten(), dtype="<i4").reshape(-1, width)
            norms = block_norms(v.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array([x.tobytes() for x in m], pa.binary()) for m in (v, norms)]], ["vec_id", "v", "norms"])

    centroids = _first(rows, seed, k)
    if not len(centroids):
        if rows.isEmpty():
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, measured int")
        raise ValueError("no vector has an id, so none can start a centroid")
    packed = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(compress, "vec_id bigint, v binary, norms binary"), "vectors")
    for _ in range(rounds):
        centroids = _moved(packed, centroids, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, measured = nearest(*_block(batch, width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(measured.astype(np.int32))], ["vec_id", "cluster", "distance", "measured"])

    found = written(packed.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint, measured int"), "assigned")
    hashes = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = sums.join(F.broadcast(hashes), "cluster").crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))  # k rows and one row
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")


def _moved(packed: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after one round: each task sends one exact sum for each of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * width for _ in centroids], [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, norms = _block(batch, width)
            number, _, _ = nearest(v, norms, centroids)
            for c in np.unique(number).tolist():
                mine = v[number == c]
                count[c] += len(mine)
                total[c] = [a + b for a, b in zip(total[c], mine.sum(axis=0).tolist(), strict=True)]
        some = [c for c, n in enumerate(count) if n]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[c] for c in some], pa.int64()), pa.array([total[c] for c in some], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    each = packed.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    exact = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    out = centroids.copy()
    for r in each.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # a row for each centroid
        out[r.cluster] = [int(r[f"t{i}"]) // r.n for i in range(width)]
    return out
