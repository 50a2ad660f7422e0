"""Near copies by SimHash: several narrow fingerprints of word shingles, joined by their tries, then checked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.graph import connected_components
from strandline.llm.passages import _ODD, _mixed, _words
from strandline.session import written

#: Words of a shingle; the least Jaccard similarity, as a fraction, of the shingle sets of near copies.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bits in which two fingerprints of a pair that is compared may differ; the share of pairs just as similar as SIMILAR that no fingerprint may find.
BUDGET, MISS = 3, 0.01
#: Fingerprints of a text whose tries are walked first, for pairs that connect most of what is alike; then all are, for pairs of what is still apart.
FIRST = 2
#: Longs of a set's parities that its fingerprints carry, so that pairs are ruled out where they meet.
MARKS = 4
#: Signatures that are broadcast to the texts (about 20 MB); for more the texts are shuffled.
BROADCAST = 500_000


def widths(texts: int) -> tuple[int, int]:
    """(bits, repeats): fingerprints of so many bits that few texts of so many agree by chance, and so many of them that MISS holds.

    A bit of two sets differs with the angle between them over pi; sets of Jaccard similarity s have a cosine of 2 s / (1 + s).
    """
    bits = min(64, max(24, math.ceil(math.log2(max(texts, 2))) + 14))
    s = SIMILAR[0] / SIMILAR[1]
    p = math.acos(2 * s / (1 + s)) / math.pi
    hit = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(BUDGET + 1))
    return bits, math.ceil(math.log(MISS) / math.log(1 - hit))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words (between ASCII blanks, A-Z lowered); of all words if they are fewer."""
    words = _words(text)
    k = min(SHINGLE, len(words))
    if not k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    whole = words[:n] * _ODD[0]
    for i in range(1, k):
        whole = whole + words[i : i + n] * _ODD[i]
    return np.unique(_mixed(whole))


def _signature(found: np.ndarray) -> int:
    return int(_mixed(found ^ _ODD[2]).sum(dtype=np.uint64).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """Bit by bit whether an odd number of the hashes fall on it; about a bit for each hash. What lies in one set only changes one bit."""
    size = max(64, 1 << max(0, len(found) - 1).bit_length())
    on = np.bincount(((found >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(on.astype(bool), bitorder="little")


def marks(found: np.ndarray) -> np.ndarray:
    """Parities on MARKS * 64 bits, whatever the size of the set, as longs."""
    on = np.bincount(((found >> np.uint64(20)) & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(on.astype(bool), bitorder="little").view(np.int64)


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """So many hashes at least are in just one of the sets with these parities."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def fingerprints(found: np.ndarray, bits: int, repeats: int) -> np.ndarray:
    """SimHash fingerprints of a set of hashes: a bit is 1 if it is set in over half of the hashes as mixed for it; each takes the next `bits` of them."""
    if not len(found):
        return np.zeros(repeats, np.uint64)
    lanes = -(-bits * repeats // 64)
    ones = []
    for i in range(lanes):
        mixed = _mixed(_mixed(found ^ np.uint64(0x9FB21C651E98DF25 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * _ODD[4])
        seen = np.bincount((mixed.view(np.uint8).reshape(len(found), 8) + simhash._COLUMN).ravel(), minlength=2048).reshape(8, 256)
        ones.append((seen @ simhash._BYTE_BITS).ravel())
    on = (np.concatenate(ones)[: bits * repeats] * 2 > len(found)).reshape(repeats, bits)
    return on.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))


def _printed(bits: int, repeats: int):
    """(doc_id, t, sig, n, bits, marks, fps) of each text: the signature of its set, the set's size, its parities, those on few bits and its fingerprints."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, parity, few, fps = [], [], [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = shingles(text.as_py())
                sigs.append(_signature(found))
                sizes.append(len(found))
                parity.append(parities(found).tobytes())
                few.append(marks(found))
                fps.append(fingerprints(found, bits, repeats))
            flat = np.concatenate([np.empty(0, np.uint64), *fps]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * repeats), pa.array(flat))
            marked = pa.ListArray.from_arrays(pa.array(np.arange(len(few) + 1, dtype=np.int32) * MARKS), pa.array(np.concatenate([np.empty(0, np.int64), *few])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parity, pa.binary()), marked, listed], ["doc_id", "t", "sig", "n", "bits", "marks", "fps"]
            )

    return made


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and parities don't rule out that they are similar enough."""
    p, q = SIMILAR
    for batch in batches:
        both = zip(batch.column("bits").to_pylist(), batch.column("other").to_pylist(), batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True)
        good = [q * min(n, m) >= p * max(n, m) and (p + q) * least_apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (q - p) * (n + m) for x, y, n, m in both]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text that has the signature `sig`."""
    for batch in batches:
        sigs, kept, made = batch.column("sig").to_pylist(), [], []
        for sig, text in zip(sigs, batch.column("text").cast(pa.large_binary()), strict=True):
            found = shingles(text.as_py())
            if _signature(found) == sig:
                kept.append(sig)
                made.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(made, pa.binary())], ["sig", "held"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("held"), batch.column("other"), strict=True):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _forest(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of items (x, y) connect, without a circle, all that the pairs connect; the classes they join get one label, the smallest."""
    chosen, live = [], np.flatnonzero(label[x] != label[y])
    while len(live):
        a, b = label[x[live]], label[y[live]]
        high, first = np.unique(np.maximum(a, b), return_index=True)  # each joins a smaller one
        chosen.append(live[first])
        to = np.arange(label.max() + 1)
        to[high] = np.minimum(a, b)[first]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]
        live = live[label[x[live]] != label[y[live]]]
    return np.concatenate(chosen) if chosen else live


def _crossing(bits: int, forest: bool):
    """Pairs of signatures of unlike roots whose fingerprints differ within the budget and which sizes and parities on few bits don't rule out; rows come ordered by subtrie.

    In a group of texts that are alike, but less than SIMILAR, nearly all pairs of fingerprints come here; parities leave few of them.
    A pair that agrees on several runs is given by the first. With forest a chunk gives just pairs that connect what its pairs connect, fewer than its rows.
    """
    p, q = SIMILAR
    few = [f"m{i}" for i in range(MARKS)]
    blocks = simhash._blocks(bits, BUDGET)
    masks = [[((1 << m) - 1) << (64 - bits + a - s - m) for s, m in blocks[:i]] for i, (a, _) in enumerate(blocks)]  # where the runs before a run lie once it has been turned to the front

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, at in simhash._by_subtrie(batches, ["side", "value", "depth", "sig", "root", "n", *few]):
            values, run = c["value"].view(np.uint64), c["run"]
            label = np.unique(c["root"], return_inverse=True)[1]
            for d, f in simhash._nodes(c, at):
                for x, y in simhash.trie_pairs(values, f, d, BUDGET, label):
                    n, m = c["n"][x], c["n"][y]
                    apart = sum(np.bitwise_count((c[k][x] ^ c[k][y]).view(np.uint64)).astype(np.int64) for k in few)
                    good = (q * np.minimum(n, m) >= p * np.maximum(n, m)) & ((p + q) * apart <= (q - p) * (n + m))
                    x, y = x[good], y[good]
                    new = np.ones(len(x), bool)
                    for i, before in enumerate(masks):
                        for mask in before:
                            new &= (run[x] != i) | (((values[x] ^ values[y]) & np.uint64(mask)) != 0)
                    x, y = x[new], y[new]
                    if forest:
                        chosen = _forest(label, x, y)
                        x, y = x[chosen], y[chosen]
                    a, b = c["sig"][x], c["sig"][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return walk


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose sets are similar enough: first by their parities, which rule most others out, then by the sets."""
    pairs = pairs.distinct()
    left = classes.select(F.col("sig").alias("a"), "n", "bits")
    right = classes.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    pairs = written(pairs.join(left, "a").join(right, "b").select("a", "b", "bits", "other", "n", "m").mapInArrow(_plausible, "a bigint, b bigint"), "plausible")
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = written(ends.join(classes, "sig").select("sig", F.col("first.doc_id").alias("_d"), F.col("first.t").alias("_t")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    read = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_d"]) & (docs["t"] == wanted["_t"])).select("sig", "text").mapInArrow(_sets, "sig bigint, held binary")
    sets = written(read.dropDuplicates(["sig"]), "sets")
    both = pairs.join(sets.withColumnRenamed("sig", "a"), "a").join(sets.withColumnsRenamed({"sig": "b", "held": "other"}), "b").select("a", "b", "held", "other")
    return written(both.mapInArrow(_similar, "a bigint, b bigint"), "similar")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): doc_id, t and sig of each row; sig, root and the first (doc_id, t) of each set of shingles."""
    bits, repeats = widths(docs.count())
    named = _named(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = written(named.mapInArrow(_printed(bits, repeats), f"doc_id {kind}, t bigint, sig bigint, n int, bits binary, marks array<bigint>, fps array<bigint>"), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    classes = prints.groupBy("sig").agg(F.min(first).alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("marks").alias("marks"), F.max("fps").alias("fps"))
    classes = written(classes, "classes")
    rows = classes.select("sig", F.posexplode("fps").alias("rep", "fp"))
    stars = rows.groupBy("rep", "fp").agg(F.min("sig").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = rows.join(stars, ["rep", "fp"]).where("sig <> a").select("a", F.col("sig").alias("b"))
    found = _verified(stars, named, classes)
    few = [F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)]
    whole = F.col("fps")
    for fps in (F.slice("fps", 1, FIRST), whole):
        roots = written(connected_components(found), "roots")
        rows = classes.join(roots, classes.sig == roots.node, "left").select("sig", "n", F.coalesce("root", "sig").alias("root"), *few, F.posexplode(fps).alias("rep", "fp"))
        crossing = simhash.subtries(rows, bits, BUDGET, ["sig", "root", "n", *[f"m{i}" for i in range(MARKS)]]).mapInArrow(_crossing(bits, fps is not whole), "a bigint, b bigint")
        found = written(found.unionByName(_verified(crossing, named, classes)), "found")
    roots = connected_components(found)
    classes = classes.join(roots, classes.sig == roots.node, "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    return prints.select("doc_id", "t", "sig"), classes


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of docs.

    Texts are linked if the Jaccard similarity of their sets of shingles is SIMILAR or more and one of their fingerprints differs
    in at most BUDGET bits, which misses at most a share MISS of the least similar links; component_id is the smallest doc_id
    that links reach, null if no row of the component has one. Texts without words, null ones too, are alike; repeated rows each give a row;
    long texts are read whole. Texts whose fingerprints agree are compared with the first of them; then
    tries are walked for pairs that still lie in different components and that parities don't rule out, which give a pair's least distance and so hide no link:
    those of FIRST fingerprints for a forest of such pairs, of which the similar ones connect most of a group, then all of them for every pair that is left.
    """
    prints, classes = _rooted(docs)
    least = classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    return prints.join(classes.join(least, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each group of near copies: that of the smallest doc_id.

    Decisions are on texts, not ids: of rows that share a doc_id but not a text each is judged for itself, the smaller hash of the text going first
    among equals; rows without doc_id come after all others. Of rows alike in doc_id and text the one with the smallest hash of all its columns stays.
    """
    chosen = _rooted(docs)[1].groupBy("root").agg(F.min("first").alias("first"))
    name = lambda doc_id: F.xxhash64(doc_id, doc_id.isNull())
    chosen = chosen.select(name(F.col("first.doc_id")).alias("_k"), F.col("first.t").alias("_t"))
    rows = docs.select(name(F.col("doc_id")).alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), F.xxhash64(F.to_json(F.struct("*"))).alias("_h"), F.struct("*").alias("_row"))
    kept = rows.join(chosen, ["_k", "_t"], "left_semi").groupBy("_k", "_t").agg(F.min_by("_row", "_h").alias("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
