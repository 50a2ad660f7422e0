"""SimHash near-duplicates by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import connected_components
from strandline.session import written

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Rows of a subtrie beyond which it is split.
SUBTRIE = 16_384
#: Rows that a task walks at once; a subtrie is never cut.
CHUNK = 1 << 16
#: Node pairs, and pairs of fingerprints, that a task holds at once; what is beyond waits on a stack. Pairs of a node pair that are compared at once.
FRONTIER, LEAF = 1 << 17, 16
#: Split subtries that are broadcast (each stands for SUBTRIE rows or more); more are joined by a shuffle.
BROADCAST = 100_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the word shingles of the lower-cased text."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n
    )
    seen = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        made = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64 fingerprint bits as a signed long, a row for each input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def _fold(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make root, the smallest known member of each item's class, join the classes of the items x and y, pair by pair."""
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return
        root[:] = after


def _crossed(values: np.ndarray, f: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of items of node pairs that differ within the budget; a node with itself gives each pair once."""
    alo, ahi, blo, bhi, _ = f
    wide = bhi - blo
    many = (ahi - alo) * wide
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = np.repeat(wide, many)
    x, y = np.repeat(alo, many) + at // wide, np.repeat(blo, many) + at % wide
    good = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
    return x[good], y[good]


def trie_pairs(values: np.ndarray, nodes: np.ndarray, depth: int, budget: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (x, y), x before y, of uint64 values that differ in at most `budget` bits.

    A node of the trie is a range of values, sorted within it, with a common prefix of `depth` bits; nodes holds pairs
    of them as columns (start, stop, start, stop, bits that differ above), a node with itself among them. Pairs
    of nodes are walked together; a step to children with unlike bits spends one of the budget, and a pair that
    has spent more is dropped with all below it. So is a pair all of whose items bear one label; labels may change between blocks.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, nodes)]
    while stack:
        d, f = stack.pop()
        if label is not None and f.shape[1]:
            turns = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            alo, ahi, blo, bhi, _ = f
            f = f[:, (turns[ahi - 1] != turns[alo]) | (turns[bhi - 1] != turns[blo]) | (label[alo] != label[blo])]
        if not f.shape[1]:
            continue
        alo, ahi, blo, bhi, diff = f
        many = (ahi - alo) * (bhi - blo)
        if f.shape[1] > 1 and many[many <= LEAF].sum() + f.shape[1] > FRONTIER:
            stack += [(d, part) for part in np.array_split(f, 2, axis=1)]
            continue
        done = (many <= LEAF) | (d == BITS)
        large = done & (many > FRONTIER)
        if large.any():  # of equal values: row by row, so that a block stays small
            cut = [np.array([[i, min(i + max(1, FRONTIER // (y1 - y0)), x1), y0, y1, s] for i in range(x0, x1, max(1, FRONTIER // (y1 - y0)))], dtype=np.int64).T for x0, x1, y0, y1, s in f[:, large].T.tolist()]
            stack += [(BITS, part[:, i : i + 1]) for part in cut for i in range(part.shape[1])]
        done &= ~large
        if done.any():
            x, y = _crossed(values, f[:, done], budget)
            if label is not None:
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
            if len(x):
                yield x, y
        f = f[:, ~(done | large)]
        if not f.shape[1]:
            continue
        alo, ahi, blo, bhi, diff = f
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)))
        c = ones[d]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = (alo == blo) & (ahi == bhi)
        parts = []
        for x0, x1, y0, y1, more, mirrored in ((alo, am, blo, bm, 0, False), (am, ahi, bm, bhi, 0, False), (alo, am, bm, bhi, 1, False), (am, ahi, blo, bm, 1, True)):
            keep = (x0 < x1) & (y0 < y1) & (diff + more <= budget)
            if mirrored:
                keep &= ~same
            parts.append(np.stack((x0[keep], x1[keep], y0[keep], y1[keep], diff[keep] + more)))
        stack.append((d + 1, np.concatenate(parts, axis=1)))


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 runs of bits: fingerprints that differ in at most `budget` bits agree on all of one run."""
    at = [i * bits // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def _masks(bits: int, budget: int) -> list[int]:
    found = {0}
    for _ in range(budget):
        found |= {m ^ (1 << i) for m in found for i in range(bits)}
    return sorted(m for m in found if m.bit_count() <= budget)


def subtries(fps: DataFrame, bits: int, budget: int, payload: list[str]) -> DataFrame:
    """The rows of fps (rep, fp, payload), dealt to the pairs of subtries that a task walks and sorted in them.

    Each fingerprint is turned so that one of its budget + 1 runs of bits comes first, once for each run; the run names the
    subtrie, so a row is copied budget + 1 times however many rows there are. A subtrie of more than SUBTRIE rows is
    walked one level of pairs further down by enumeration: its rows go to the pairs of its own subtries whose prefixes
    differ within the budget.
    """
    mask = (1 << bits) - 1

    def turned(by: int) -> Column:
        whole = F.col("fp")
        if by:
            whole = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", bits - by))
        if bits < 64:
            whole = F.shiftleft(whole.bitwiseAND(F.lit(mask).cast("bigint")), 64 - bits)
        return whole

    made = [F.struct(F.lit(i).alias("run"), turned(start).alias("value"), F.lit(length).alias("depth")) for i, (start, length) in enumerate(_blocks(bits, budget))]
    rows = fps.select("rep", *payload, F.explode(F.array(*made)).alias("x")).select("rep", *payload, "x.*")
    rows = rows.withColumn("prefix", F.expr("shiftrightunsigned(value, 64 - depth)"))
    node = ["rep", "run", "prefix"]
    hot = rows.groupBy(*node).count().where(F.col("count") > SUBTRIE)
    hot = written(hot.select(*node, F.least(2 * F.ceil(F.log2(F.col("count") / SUBTRIE)), F.lit(16)).cast("int").alias("more")), "hot")
    n = hot.count()
    none = F.lit(0).cast("bigint")
    if n:
        rows = rows.join(F.broadcast(hot) if n <= BROADCAST else hot, node, "left")
        plain = rows.where(F.col("more").isNull()).drop("more").select("*", none.alias("low"), none.alias("high"), none.alias("side"))
        split = rows.where(F.col("more").isNotNull()).withColumn("side", F.expr("shiftrightunsigned(shiftleft(value, depth), 64 - more)"))
        steps = F.coalesce(*[F.when(F.col("more") == m, F.array(*[F.lit(x).cast("bigint") for x in _masks(m, budget)])) for m in range(2, 17, 2)])
        split = split.select("*", F.explode(steps).alias("mask")).withColumn("other", F.col("side").bitwiseXOR(F.col("mask")))
        split = split.withColumn("depth", F.col("depth") + F.col("more")).withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("more", "mask", "other")
        rows = plain.unionByName(split)
    else:
        rows = rows.select("*", none.alias("low"), none.alias("high"), none.alias("side"))
    keys = [*node, "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "value")


def _by_subtrie(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Some CHUNK rows at a time, by column, that hold whole subtrie pairs, and where these start."""
    keys = ["rep", "run", "prefix", "low", "high"]
    held: list[np.ndarray] = []

    def given(rows: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        new = np.flatnonzero((rows[: len(keys), 1:] != rows[: len(keys), :-1]).any(axis=0)) + 1
        return dict(zip([*keys, *names], rows, strict=True)), np.concatenate(([0], new, [rows.shape[1]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, *names]]))
        if sum(x.shape[1] for x in held) < CHUNK:
            continue
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[: len(keys)] != rows[: len(keys), -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield given(rows[:, :cut])
        held = [rows[:, cut:]]
    if held:
        yield given(np.concatenate(held, axis=1))


def _nodes(c: dict[str, np.ndarray], at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The node pairs to start from, by depth."""
    start, stop = at[:-1], at[1:]
    low, high = c["low"][start], c["high"][start]
    right = np.concatenate(([0], np.cumsum(c["side"] != c["low"])))  # rows of the higher side come last
    middle = np.where(low == high, stop, stop - (right[stop] - right[start]))
    own = low == high
    f = np.stack((start, middle, np.where(own, start, middle), stop, np.bitwise_count((low ^ high).view(np.uint64)).astype(np.int64)))
    worth = (f[0] < f[1]) & (f[2] < f[3]) & (~own | (f[1] - f[0] > 1))
    depth = c["depth"][start]
    for d in np.unique(depth[worth]).tolist():
        yield d, f[:, worth & (depth == d)]


def _forest(bits: int, budget: int):
    """Edges (fingerprint, root) that connect what pairs of a chunk connect."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([s for s, _ in _blocks(bits, budget)])
        for c, at in _by_subtrie(batches, ["side", "value", "depth"]):
            values = c["value"].view(np.uint64)
            back = starts[c["run"]].astype(np.uint64)
            raw = values >> np.uint64(64 - bits)
            fps = np.where(back > 0, (raw >> back) | (raw << ((np.uint64(bits) - back) & np.uint64(63))), raw) & np.uint64((1 << bits) - 1)
            root = np.arange(len(values))
            for d, f in _nodes(c, at):
                for x, y in trie_pairs(values, f, d, budget, root):
                    _fold(root, x, y)
            item = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[item].view(np.int64)), pa.array(fps[root[item]].view(np.int64))], ["a", "b"])

    return walk


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): edges that connect just the fingerprints that chains of links within the budget connect.

    fps: distinct `fp`. A task walks subtries and returns a forest, not all pairs.
    """
    dealt = subtries(fps.select(F.lit(0).alias("rep"), "fp"), BITS, budget, [])
    return dealt.mapInArrow(_forest(BITS, budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id that links of at most `budget` bits reach. Null and empty
    texts have fingerprint zero and link as any other; repeated rows each give a row; rows with a
    null doc_id get the component of their fingerprint, null if it has no other id. Further
    columns are ignored.
    """
    prints = written(simhash(docs), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    roots = connected_components(links(classes.select("fp"), budget))
    linked = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    final = linked.join(lowest, "root").select("fp", "component_id")
    return prints.join(final, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
