"""Decontamination against brute force over all places: every place with a share of 0.8 equal words is hit."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from strandline.llm import decontaminate

from . import brute


def test_pieces_leave_out_no_substitutions():
    for n in range(1, 26):
        changed = n // 5
        picked = [{at + i for i, bit in enumerate(mask) if bit == "1"} for at, mask in decontaminate.pieces(n, 0.8)]
        rng = random.Random(n)
        choices = list(combinations(range(n), changed)) if n < 20 else [rng.sample(range(n), changed) for _ in range(5000)]
        assert all(any(not p & set(c) for p in picked) for c in choices) and all(p and max(p) < n for p in picked)


@pytest.mark.parametrize("max_seeds", [2_000_000, 100])
def test_every_place_is_found(spark, max_seeds):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(n * 10 + k, [f"i{n}x{rng.randrange(9)}" if rng.random() < 0.6 else word() for _ in range(n)]) for n in range(1, 31) for k in range(2)]
    docs = []
    for i, item in items:
        for d in range(6):
            copy = list(item)
            for at in rng.sample(range(len(item)), min(len(item) // 5 + (d == 5), len(item))):
                copy[at] = word()
            lead, tail = (0, 0) if d == 0 else (rng.randrange(20), rng.randrange(20))
            copy = copy[1:] if d == 4 and len(copy) > 5 else copy  # the item begins before the document
            docs.append((i * 10 + d, [*[word() for _ in range(lead)], *copy, *[word() for _ in range(tail)]]))
    want = set()
    for d, text in docs:
        for i, item in items:
            if any(sum(0 <= at + k < len(text) and text[at + k] == w for k, w in enumerate(item)) / len(item) >= 0.8 for at in range(1 - len(item), len(text))):
                want.add((d, i))
    frame = brute.frame(spark, [(d, " ".join(t), "en", "s") for d, t in docs])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = decontaminate.overlaps(frame, bench, max_seeds=max_seeds).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.overlap >= 0.8} == want
    assert all(r.overlap >= 0.8 or r.stretch >= 13 for r in got)
