"""Toxicity by a linear-chain conditional random field that tags offending words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.language import held_out
from strandline.session import written

#: Labelled documents that teach: those with the smallest hashes of their doc_id.
MAX_DOCS = 20_000
#: Chains of words from them that the field is fitted on: all with a candidate word first, then others, by hash.
MAX_CHAINS = 20_000
#: Words of a chain; longer texts are cut into several.
CHAIN = 64
#: A feature (word or beginning of a word) marks candidates if this share of toxic documents has it, at least 4 do, and log odds are as high.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, MAX_FEATURES = 0.01, 4, 2.0, 20_000
PREFIXES = (3, 4, 5, 6, 7)
STEPS, RATE, RIDGE = 80, 0.3, 1e-4
#: Chains whose marginals the driver holds at once in fitting.
AT_ONCE = 4096

_WORD = re.compile(r"\w+")
#: Words whose features a task remembers at once.
_REMEMBERED = 400_000


def _words(text: str | None) -> list[str]:
    """The words of a text, each lower-cased for itself, so that their places are those in the text."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with the toxic and other documents that have them, as far as a task has read."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = set(_words(text.as_py()))
            seen[toxic].update({f for w in words for f in _features(w)})
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][f] for f in every], pa.int64()), pa.array([seen[0][f] for f in every], pa.int64())], ["feature", "yes", "no"])


def _cut(batch_texts: list[str | None], index: Callable[[list[str]], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains of the texts: word numbers (chains x CHAIN, -1 where there is none), their neighbours' numbers, and the text of each chain."""
    ids, neighbours_l, neighbours_r, owner = [], [], [], []
    for i, text in enumerate(batch_texts):
        words = _words(text)
        if not words:
            continue
        own = np.array(index(words), np.int64)
        n = -(-len(own) // CHAIN)
        left, right = np.concatenate(([0], own[:-1])), np.concatenate((own[1:], [0]))
        for part, to in ((own, ids), (left, neighbours_l), (right, neighbours_r)):
            full = np.full(n * CHAIN, -1, np.int64)
            full[: len(part)] = part
            to.append(full.reshape(n, CHAIN))
        owner.append(np.full(n, i))
    if not ids:
        return (np.empty((0, CHAIN), np.int64),) * 3 + (np.empty(0, np.int64),)
    return tuple(np.concatenate(x) for x in (ids, neighbours_l, neighbours_r, owner))


def _marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over two tags: P(tag 1) of each word, expected moves (2 x 2) of all chains, log partition of each.

    scores: of tag 1 against tag 0 by word; moves: of a tag after another. Words beyond a chain's end pass all on as it is.
    """
    n, length = scores.shape
    up, move = np.exp(np.clip(scores, -30, 30)), np.exp(moves)
    ahead = np.empty((length, n, 2))
    a = np.stack((np.ones(n), up[:, 0]), axis=1)
    log = np.zeros(n)
    for t in range(length):
        if t:
            b = a @ move
            b[:, 1] *= up[:, t]
            a = np.where(mask[:, t, None], b, a)
        total = a.sum(axis=1)
        a = a / total[:, None]
        log += np.log(total)
        ahead[t] = a
    out, expected = np.zeros((n, length)), np.zeros((2, 2))
    b = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        joint = ahead[t] * b
        out[:, t] = joint[:, 1] / joint.sum(axis=1)
        if t:
            weighted = np.stack((b[:, 0], b[:, 1] * up[:, t]), axis=1)
            pair = ahead[t - 1][:, :, None] * move[None] * weighted[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += pair[mask[:, t]].sum(axis=0)
            back = weighted @ move.T
            b = np.where(mask[:, t, None], back / back.sum(axis=1, keepdims=True), b)
    return np.where(mask, out, 0.0), expected, log


class Field:
    """Weights of features for a word and its two neighbours, of tag moves, and of a document's summary."""

    def __init__(self, features: list[str]):
        self.features = {f: i + 1 for i, f in enumerate(features)}
        self.weights = np.zeros((3, len(features) + 1))
        self.bias, self.moves, self.summary = 0.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, 0.0])

    def index(self) -> tuple[Callable[[list[str]], list[int]], list[tuple[int, ...]]]:
        """A function from words to numbers, 0 for words without features, and the features by number, which grows."""
        known: dict[str, int] = {}
        kinds: dict[tuple[int, ...], int] = {(): 0}
        listed: list[tuple[int, ...]] = [()]
        have = self.features

        class Table(dict):
            def __missing__(self, word: str) -> int:
                kind = tuple(have[f] for f in _features(word) if f in have)
                if kind not in kinds:
                    kinds[kind] = len(listed)
                    listed.append(kind)
                if len(self) >= _REMEMBERED:
                    self.clear()
                self[word] = kinds[kind]
                return kinds[kind]

        known = Table()
        return lambda words: [known[w] for w in words], listed

    def scores(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, kinds: list[tuple[int, ...]]) -> np.ndarray:
        by_kind = np.array([[self.weights[r, list(k)].sum() for k in kinds] for r in range(3)])
        return self.bias + by_kind[0, own] + by_kind[1, left] + by_kind[2, right]

    def fit(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, tags: np.ndarray, kinds: list[tuple[int, ...]]) -> None:
        """Maximise the likelihood of the tags by Adam on all chains."""
        mask = own >= 0
        size = np.array([len(k) for k in kinds])
        kind, feature = np.repeat(np.arange(len(kinds)), size), np.array([f for k in kinds for f in k], np.int64)
        seen = np.array([[np.bincount(x[mask], tags[mask], len(kinds))] for x in (own, left, right)])[:, 0]
        moved = np.zeros((2, 2))
        pairs = mask[:, 1:]
        np.add.at(moved, (tags[:, :-1][pairs].astype(int), tags[:, 1:][pairs].astype(int)), 1)
        m1 = m2 = 0.0
        shape = self.weights.size
        theta = np.zeros(shape + 5)
        for step in range(1, STEPS + 1):
            self.weights, self.bias, self.moves = theta[:shape].reshape(self.weights.shape), theta[shape], theta[shape + 1 :].reshape(2, 2)
            gap, expected, total = seen.copy(), np.zeros((2, 2)), 0.0
            for low in range(0, len(own), AT_ONCE):
                a, b, c, m = (x[low : low + AT_ONCE] for x in (own, left, right, mask))
                p, some, _ = _marginals(self.scores(a, b, c, kinds), m, self.moves)
                gap -= [np.bincount(x[m], p[m], len(kinds)) for x in (a, b, c)]
                expected += some
                total += p.sum()
            by_feature = np.array([np.bincount(feature, g[kind], self.weights.shape[1]) for g in gap]) if len(feature) else np.zeros(self.weights.shape)
            slope = np.concatenate((by_feature.ravel(), [tags[mask].sum() - total], (moved - expected).ravel())) / len(own) - RIDGE * theta
            m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
            theta = theta + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias, self.moves = theta[:shape].reshape(self.weights.shape), theta[shape], theta[shape + 1 :].reshape(2, 2)

    def read(self, texts: list[str | None], index: Callable[[list[str]], list[int]], kinds: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: a summary (1, greatest marginal, log of the expected offending words, their share); then marginals and texts of chains."""
        own, left, right, owner = _cut(texts, index)
        summary = np.zeros((len(texts), 4))
        summary[:, 0] = 1
        p = np.zeros(own.shape)
        if len(own):
            mask = own >= 0
            p, _, _ = _marginals(self.scores(own, left, right, kinds), mask, self.moves)
            n = np.bincount(owner, mask.sum(axis=1), len(texts))
            total = np.bincount(owner, p.sum(axis=1), len(texts))
            np.maximum.at(summary[:, 1], owner, p.max(axis=1))
            summary[:, 2], summary[:, 3] = np.log1p(total), 10 * total / np.maximum(n, 1)
        return summary, p, owner


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about a million characters, so that memory doesn't follow the rows."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= 1 << 20:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """A field fitted on at most MAX_DOCS labelled documents of which none is held out.

    Labels mark documents, so words are labelled first: those with a feature that toxic documents have far
    more often offend where they stand in a toxic document. A doc_id with several labels is toxic if one says so, one with several texts teaches the one of the smallest hash; nulls teach nothing.
    """
    sample = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS)
    )
    taught = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    taught = taught.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    taught = written(taught.select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    least = max(LEAST_DOCS, LEAST_SHARE * yes)
    odds = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("no") + 0.5) / (no + 1.0))
    found = (
        taught.mapInArrow(_counts, "feature string, yes bigint, no bigint").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        .where((F.col("yes") >= least) & (odds >= LEAST_ODDS)).orderBy(F.desc(odds), "feature").limit(MAX_FEATURES).select("feature")
    )
    field = Field([r[0] for r in found.collect()])
    if not yes:
        field.summary = np.array([-6.0, 0.0, 0.0, 0.0])
        return field

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = _words(text.as_py())
                marked = [w if any(f in field.features for f in _features(w)) else "" for w in words]
                rows += [(" ".join(marked[i : i + CHAIN]), toxic) for i in range(0, len(marked), CHAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["words", "toxic"])

    some = F.trim("words") != ""  # words that are no candidates are empty
    picked = taught.mapInArrow(chains, "words string, toxic int").orderBy(~some, F.xxhash64("words"), "toxic").limit(MAX_CHAINS).collect()
    index, kinds = field.index()
    own, left, right, owner = [], [], [], np.array([r["toxic"] for r in picked])
    for row in picked:
        ids = np.array(index(row["words"].split(" ")), np.int32)
        for x, to in ((ids, own), (np.concatenate(([0], ids[:-1])), left), (np.concatenate((ids[1:], [0])), right)):
            to.append(np.concatenate((x, np.full(CHAIN - len(x), -1))).astype(np.int32))
    own, left, right = np.stack(own), np.stack(left), np.stack(right)
    del picked
    tags = ((own > 0) & (owner[:, None] == 1)).astype(float)
    field.fit(own, left, right, tags, kinds)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = field.index()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = np.concatenate([field.read(texts[a:b], index, kinds)[0] for a, b in _groups(texts)])
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 1]), pa.array(made[:, 2]), pa.array(made[:, 3]), batch.column("toxic")], ["a", "b", "c", "toxic"])

    alike = taught.mapInArrow(summaries, "a double, b double, c double, toxic int").groupBy("a", "b", "c", "toxic").agg(F.count("*").alias("k"))
    rows = np.array(sorted(tuple(r) for r in alike.collect()))  # MAX_DOCS at most
    x, y, k = np.column_stack((np.ones(len(rows)), rows[:, :3])), rows[:, 3], rows[:, 4]
    weights = np.zeros(4)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (k * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05, 0.05])
        weights = weights + np.linalg.solve(h, x.T @ (k * (y - p)) - np.array([1e-3, 0.05, 0.05, 0.05]) * weights)
    field.summary = weights
    return field


def score(docs: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of docs.

    score: probability, from the tags' forward-backward marginals over all words, that the document is
    labelled toxic; predicted: 1 from 0.5. spans: start:end code points of words whose marginal is 0.5 or more,
    comma-joined. Null and empty texts get what a document without words gets. Without toxic labels all scores
    are near 0. Repeated rows repeat. Only texts, whole ones, are read to score; further columns are ignored.
    """
    field = learn(docs, labels) if field is None else field

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = field.index()
        for batch in batches:
            scores, spans = [], []
            texts = batch.column("text").to_pylist()
            for low, high in _groups(texts):
                summary, p, owner = field.read(texts[low:high], index, kinds)
                scores.append(1 / (1 + np.exp(-np.clip(summary @ field.summary, -30, 30))))
                found = [""] * (high - low)
                for i in np.unique(owner[(p >= 0.5).any(axis=1)]):
                    hit = p[owner == i].ravel() >= 0.5
                    found[i] = ",".join(f"{w.start()}:{w.end()}" for w, h in zip(_WORD.finditer(texts[low + i]), hit, strict=False) if h)
                spans += found
            flat = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flat), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, spans string")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below 0.5, with all their columns, in one pass over them."""
    field = learn(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = field.index()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for low, high in _groups(texts):
                summary, _, _ = field.read(texts[low:high], index, kinds)
                stays = summary @ field.summary < 0
                yield batch.slice(low, high - low).filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)
