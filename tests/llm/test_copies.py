"""The near-copies stage of the pipeline against Jaccard similarities of all pairs."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from strandline.llm import copies, simhash
from strandline.session import table

from . import brute


def shingles(text):
    found = brute.lower(text or "").split()
    k = min(5, len(found))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()


def brute_roots(rows):
    """doc_id: smallest doc_id of its component."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if (not x and not y) or 5 * len(x & y) >= 4 * len(x | y)]
    return brute.components(edges, [d for d, _ in sets])


def planted():
    """Copies with every share of changed words, chains, a passage and a line of many texts, a large group, short and empty texts."""
    rng = random.Random(7)
    word = lambda kinds=5000: f"w{rng.randrange(kinds)}"
    texts, line, passage = [], [word() for _ in range(9)], [word() for _ in range(70)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice((4, 6, 30, 90, 250)))]
        for changed in (0, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for i in rng.sample(range(len(base)), min(changed, len(base))):
                copy[i] = word()
            texts.append(copy)
    texts += [[*[word() for _ in range(15)], *passage, *line] for _ in range(60)] + [[*passage, *[word() for _ in range(rng.randrange(12))]] for _ in range(40)]
    step = [word() for _ in range(200)]
    for i in range(0, 60, 6):  # a chain: neighbours are similar, its ends aren't
        step = [*step[:i], *[word() for _ in range(6)], *step[i + 6 :]]
        texts.append(step)
    rng.shuffle(texts)
    return [*[(i, " ".join(t)) for i, t in enumerate(texts)], (9001, None), (9002, ""), (9003, " \n"), (9004, "A b C d"), (9005, "a  B c D"), (None, " ".join(step)), (None, None)]


def test_planted(spark):
    rows = planted()
    docs = brute.frame(spark, [(d, t, "en", "s") for d, t in rows])
    roots = brute_roots(rows)
    got = copies.near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == roots and len(got) == len(rows)
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in roots if d == roots[d])
    assert copies.keep_one(brute.frame(spark, [])).count() == 0


def test_decisions_are_on_texts(spark):
    """Rows that share a doc_id but not a text are judged one by one; alike rows leave one; nameless ones come last."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (5, b), (None, b), (None, c), (None, c), (7, a + " end")]
    kept = copies.keep_one(brute.frame(spark, [(d, t, "en", "s") for d, t in rows])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", a), ("5", b), ("None", c)])


def test_hot_subtries_give_the_same(spark, monkeypatch):
    rows = planted()
    docs = brute.frame(spark, [(d, t, "en", "s") for d, t in rows])
    whole = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    monkeypatch.setattr(simhash, "SUBTRIE", 4)
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()} == whole


def test_recall_of_fingerprints():
    """Pairs of sets just as similar as SIMILAR: the share that no fingerprint finds is near MISS, at any width."""
    rng = np.random.default_rng(5)
    for texts in (1000, 250_000):
        bits, repeats = copies.widths(texts)
        missed = 0
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            a, b = copies.fingerprints(x[:900], bits, repeats), copies.fingerprints(x[100:], bits, repeats)
            missed += not (np.bitwise_count(a ^ b) <= copies.BUDGET).any()
        assert missed <= 8, (texts, bits, repeats)


def test_stage_on_documents(spark):
    """The stage leaves no pair of documents of which it should keep one (it kept all of the near, unequal ones)."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    roots = brute_roots(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id").collect()}
    assert got == {d for d in roots if d == roots[d]} and not {56, 255, 770, 875, 944} & got


def test_texts_that_are_less_alike_make_few_pairs(spark, monkeypatch):
    """200 texts of which each pair has two thirds of its shingles in common: nearly all meet in a trie, few are handed on; copies among them are found."""
    rng = random.Random(11)
    passage = " ".join(f"w{rng.randrange(9999)}" for _ in range(100))
    own = [" ".join(f"v{rng.randrange(9999)}" for _ in range(20)) for _ in range(200)]
    rows = [(i, f"{passage} {x}") for i, x in enumerate(own)] + [(500 + i, f"{passage} {own[i]} end{i}") for i in range(20)]
    given, verified = [], copies._verified
    monkeypatch.setattr(copies, "_verified", lambda pairs, *more: given.append(pairs.count()) or verified(pairs, *more))
    got = {r.doc_id: r.component_id for r in copies.near_copies(brute.frame(spark, [(d, t, "en", "s") for d, t in rows])).collect()}
    assert got == brute_roots(rows) == {d: d % 500 for d, _ in rows}
    assert sum(given) < 5000, given


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """200 texts of which all 19,900 pairs are similar and few fingerprints, of 40 bits here, are equal: what is handed on grows with the texts, not with the pairs."""
    rng = random.Random(12)
    base, rows = [f"w{rng.randrange(99999)}" for _ in range(300)], []
    for i in range(200):
        copy = list(base)
        for k in rng.sample(range(5, 295), 3):
            copy[k] = f"v{rng.randrange(99999)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(copies, "widths", lambda texts: (40, 20))
    given, verified = [], copies._verified
    monkeypatch.setattr(copies, "_verified", lambda pairs, *more: given.append(pairs.count()) or verified(pairs, *more))
    got = {r.doc_id: r.component_id for r in copies.near_copies(brute.frame(spark, [(d, t, "en", "s") for d, t in rows])).collect()}
    assert got == brute_roots(rows) == dict.fromkeys(range(200), 0)
    assert sum(given) < 10 * 200, given


def test_a_pair_is_given_once_for_a_fingerprint():
    """Of the runs on which two fingerprints agree the first gives the pair, and each pair within the budget is given."""
    rng = random.Random(13)
    bits = 30
    fps = [rng.getrandbits(bits) for _ in range(20)]
    fps += [f ^ sum(1 << i for i in rng.sample(range(bits), rng.randrange(4))) for f in fps for _ in range(3)]
    rows = []
    for i, f in enumerate(fps):
        for run, (start, length) in enumerate(simhash._blocks(bits, copies.BUDGET)):
            turned = ((f << start) | (f >> (bits - start))) & ((1 << bits) - 1)
            rows.append((0, run, turned >> (bits - length), 0, 0, 0, turned << (64 - bits), length, i, i, 9, *[0] * copies.MARKS))
    names = ["rep", "run", "prefix", "low", "high", "side", "value", "depth", "sig", "root", "n", *[f"m{i}" for i in range(copies.MARKS)]]
    rows.sort(key=lambda r: r[:7])
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*rows, strict=True)], names)
    got = [(r["a"], r["b"]) for b in copies._crossing(bits, False)(iter([batch])) for r in b.to_pylist()]
    right = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= copies.BUDGET}
    assert len(got) == len(set(got)) and set(got) == right
    forest = [(r["a"], r["b"]) for b in copies._crossing(bits, True)(iter([batch])) for r in b.to_pylist()]
    assert set(forest) <= right and brute.components(forest, range(len(fps))) == brute.components(right, range(len(fps))) and len(forest) == len(fps) - len(set(brute.components(right, range(len(fps))).values()))
