"""The q-gram index loses no pair: against all pairs, at every threshold."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from strandline.operators.matching import candidates, fuzzy_tokens


def words(rng, n, letters, low, high):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def edited(rng, word):
    w = list(word)
    for _ in range(rng.randrange(0, 4)):
        i = rng.randrange(0, len(w) + 1)
        w[i : i + rng.randrange(0, 2)] = [rng.choice("ab01")] * rng.randrange(0, 2)
    return "".join(w)


@pytest.mark.parametrize("threshold", [0.01, 0.4, 0.67, 0.7, 0.8, 0.88, 0.95, 1.0])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(int(100 * threshold))
    known = sorted({*words(rng, 120, "ab01", 1, 14), *words(rng, 10, "a", 1, 9), "abab" * 60})
    wanted = sorted({edited(rng, rng.choice(known)) for _ in range(80)} | {"b", "ab", "zz"})
    found = {(r.token, r.match) for r in candidates(spark.createDataFrame([(w,) for w in wanted], "token string"), spark.createDataFrame([(k,) for k in known], "match string"), threshold).collect()}
    lost = [(w, k) for w in wanted for k in known if SequenceMatcher(None, w, k).ratio() >= threshold and (w, k) not in found]
    assert not lost


def test_many_tokens(spark):
    """10^4 tokens: the best of all pairs, ties included, from few candidates."""
    rng = random.Random(5)
    known = sorted({f"{rng.choice(['pump', 'press', 'mill', 'cnc'])}{rng.randrange(10**6):06d}" for _ in range(10_000)})
    wanted = sorted({edited(rng, rng.choice(known)) for _ in range(120)} - set(known) - {""})
    w, k = spark.createDataFrame([(x,) for x in wanted], "token string"), spark.createDataFrame([(x,) for x in known], "token string")
    got = {}
    for r in fuzzy_tokens(w, k, 0.88).collect():
        got.setdefault(r.token, set()).add((r.match, r.score))
    want = {}
    for x in wanted:
        m = SequenceMatcher(None, b=x)
        m.set_seq2(x)
        best, at = 0.88, set()
        for y in known:
            s = SequenceMatcher(None, x, y)
            if s.real_quick_ratio() >= best and s.quick_ratio() >= best and (ratio := s.ratio()) >= best:
                at = {(y, ratio), *(at if ratio == best else ())}
                best = ratio
        if at:
            want[x] = {p for p in at if p[1] == best}
    assert got == want and len(want) > 50
    pairs = candidates(w, k.withColumnRenamed("token", "match"), 0.88).count()
    assert pairs < 0.2 * len(wanted) * len(known)


def test_numbered_names_meet_few(spark):
    """Names that share all but their number: pairs grow with the names, not with their square."""
    known = [f"machine{i:06d}" for i in range(3000)]
    w, k = spark.createDataFrame([(f"{x}x",) for x in known], "token string"), spark.createDataFrame([(x,) for x in known], "match string")
    found = [(r.token, r.match) for r in candidates(w, k, 0.95).collect()]
    assert {(f"{x}x", x) for x in known} <= set(found) and len(found) < 3 * len(known)
