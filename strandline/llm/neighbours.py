"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

#: Neighbours returned; candidates of a query that are scored exactly.
TOP, SHORTLIST = 20, 600
#: Full-dimensional codebooks, codewords of each, hypotheses kept in encoding.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors on which codebooks are fitted: those with the smallest hashes of their ids.
SAMPLE, ROUNDS = 16_000, 8
#: Codes that a task scores at once against a block of queries.
CODE_BLOCK, QUERY_BLOCK = 32_768, 4_096
#: Blocks of which a query's hits are merged in one row.
MERGED = 32


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books): of the sums of a codeword from each book, near the best; after each book the `beam` best sums go on."""
    out = np.empty((len(x), len(books)), np.uint8)
    norms = (books**2).sum(axis=2)
    for low in range(0, len(x), 1024):
        part = x[low : low + 1024]
        n = len(part)
        rest, cost, codes = part[:, None, :], np.zeros((n, 1)), np.zeros((n, 1, 0), np.uint8)
        for book, norm in zip(books, norms, strict=True):
            # |rest - c|^2 - |rest|^2, added to what the sum so far leaves
            total = cost[:, :, None] + norm - 2 * (rest @ book.T)
            flat = total.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            before, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            rest, cost = rest[row, before] - book[word], flat[row, best]
            codes = np.concatenate((codes[row, before], word[:, :, None].astype(np.uint8)), axis=2)
        out[low : low + n] = codes[np.arange(n), cost.argmin(axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(books))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books x words x dimensions): residual k-means, then least squares on the codes that beams find, twice."""
    rng = np.random.default_rng(seed)
    rest, made = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        made.append(centres)
        rest = rest - centres[(rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)]
    found = np.stack(made)
    for _ in range(2):
        codes = encode(x, found, 4)
        for i in range(books):  # each book in turn against what the others leave
            rest = x - decode(codes, found) + found[i][codes[:, i]]
            n = np.bincount(codes[:, i], minlength=words)
            sums = np.zeros_like(found[i])
            np.add.at(sums, codes[:, i], rest)
            found[i] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found[i])
    return found


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector holds finite numbers only, not all of them 0."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def search(vectors: DataFrame, every: int = 20, top: int = TOP, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found of each row whose vec_id is divisible by `every`.

    score: inner product of the original vectors, in double precision; ties go to the smaller vec_id. A
    vec_id that repeats is one vector, the smallest of its own. Rows that `usable` leaves out take no part;
    a dimension that one of two vectors lacks counts as 0. Equal vectors are one entry of
    the index, which remembers the top + 1 smallest ids, all that can be returned; so many copies of a vector crowd nothing out.
    Codebooks are fitted on SAMPLE vectors; every entry is encoded, by its direction, with the norm
    stored. Blocks of queries meet blocks of codes: tables of inner products of each query with each codeword
    give all scores of a block; each keeps its best, the best of all blocks are scored exactly.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    valid = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    valid = written(valid, "vectors")
    salted = valid.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    entries = salted.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, top + 1).alias("ids"))
    entries = written(entries.select(F.element_at("ids", 1).alias("entry"), "ids", "embedding"), "entries")
    n, width = entries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    kind = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], kind)
    shaped = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(e, i), F.lit(0)).cast("float"))
    rough = entries.select("entry", shaped.alias("embedding"))  # to learn and to encode; scores are of the vectors as they are
    learned = rough.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("embedding").toArrow()
    x = np.asarray(learned.column(0).combine_chunks().flatten(), dtype=np.float32).reshape(-1, width)
    x = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    books = fit(x).astype(np.float32)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(-1, width)
            norms = np.linalg.norm(v, axis=1)
            codes = encode((v / norms[:, None]).astype(np.float32), books)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
            lengths = np.linalg.norm(decode(codes, books), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), raw, pa.array((norms / np.maximum(lengths, 1e-9)).astype(np.float32))], ["entry", "code", "norm"])

    asked = valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("whole"), shaped.alias("q"))
    blocks, parts = -(-n // CODE_BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    codes = rough.mapInArrow(index, "entry bigint, code binary, norm float")
    codes = codes.withColumn("cb", F.pmod(F.xxhash64("entry"), F.lit(blocks))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    queries = asked.drop("whole").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("cb", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def scored(_: tuple, ask: pa.Table, have: pa.Table) -> pa.Table:
        if not ask.num_rows or not have.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "cb": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("s", pa.float32()), ("entry", pa.int64())])))})
        q = np.asarray(ask.column("q").combine_chunks().flatten(), dtype=np.float32).reshape(-1, width)
        raw = b"".join(have.column("code").to_pylist())
        code = np.frombuffer(raw, np.uint8).reshape(have.num_rows, -1)
        entry, norm = have.column("entry").to_numpy(), have.column("norm").to_numpy()
        order = np.argsort(entry)  # so that a stable sort by score breaks ties by id
        code, entry, norm = code[order], entry[order], norm[order]
        keep = min(shortlist, len(entry))
        out_s, out_e = [], []
        for low in range(0, len(q), 64):
            tables = np.einsum("qd,bwd->bqw", q[low : low + 64], books)
            s = sum(t[:, code[:, b]] for b, t in enumerate(tables)) * norm
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            out_s.append(np.take_along_axis(s, best, 1).ravel())
            out_e.append(entry[best].ravel())
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_e))], ["s", "entry"])
        found = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * keep), flat)
        return pa.table({"query_id": ask.column("query_id"), "cb": ask.column("cb"), "found": found})

    near = queries.groupBy("qb", "cb").cogroup(codes.groupBy("qb", "cb")).applyInArrow(scored, "query_id bigint, cb bigint, found array<struct<s:float,entry:bigint>>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("found")), asc=False), 1, shortlist).alias("found")
    while blocks > MERGED:  # so that no row holds the hits of more than MERGED blocks
        blocks = -(-blocks // MERGED)
        near = near.groupBy("query_id", F.pmod("cb", F.lit(blocks)).alias("cb")).agg(merged)
    best = near.groupBy("query_id").agg(merged)
    pairs = best.select("query_id", F.explode("found.entry").alias("entry"))
    exact = (
        pairs.join(entries, "entry").join(asked, "query_id")
        .select("query_id", "ids", _dot(F.col("whole"), F.col("embedding")).alias("score"))
        .select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
