"""Texts with very many hits, across the blocks in which they are counted; rows of any columns in the near-copy stage."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import copies, licenses, secrets, text

from . import brute


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 5000])
def test_scans_of_many_hits(spark, n):
    rng = random.Random(n)
    body = "".join(rng.choice(["password=abcdéfg%d " % k, "x é🙂 ", "deadbeef" * 4 + "\n", "AKIA" + "Z" * 16 + ";", "user: bob ", "secret='ab' "]) for k in range(n))
    d = spark.createDataFrame([(1, body, {"a": 1})], "doc_id long, text string, `m``x` map<string,int>").repartition(1)
    assert tuple(secrets.scan(d).first())[1:5] == brute.secrets(body)[:4]
    spans = [tuple(map(int, s.split(":")[1:])) for s in secrets.scan(d).first().spans.split(",") if s]
    runs: list[list[int]] = []
    for a, z in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    want, at = "", 0
    for a, z in runs:
        want, at = want + body[at:a] + "#", z
    assert secrets.redact(d, "#").first().text == want + body[at:]


def test_offsets_and_sums(spark):
    d = spark.createDataFrame([("ab " * 300 + "é",), ("",), ("abab",)], "t string")
    got = [[tuple(x) for x in r.s] for r in d.select(text.spans(F.col("t"), "a(b)", 1).alias("s")).collect()]
    assert got == [[(m.start(), m.end(), "b") for m in re.finditer("ab", t)] for t in ("ab " * 300 + "é", "", "abab")]
    xs = list(range(1000))
    row = spark.createDataFrame([(xs,)], "x array<int>").select(text.before(F.col("x"), lambda a, b: a + b).alias("s"), text.before(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).first()
    assert row.s == [k * (k - 1) // 2 for k in xs] and row.m == [max(k - 1, 0) for k in xs]


def test_a_hundred_thousand_hits(spark):
    n = 100_000
    one = lambda s: spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.when(F.col("id") >= 0, s), n).alias("text"))
    began = time.perf_counter()
    row = secrets.scan(one("password=abcdefg1 ")).first()
    assert row.n_assign == n and row.spans.endswith(f"assign:{18 * n - 18}:{18 * n - 1}")
    assert secrets.redact(one("password=abcdefg1 "), "#").first().text == "# " * n
    row = licenses.scan(one("under the mit license ")).first()
    assert (row.n_base, row.first_word, row.last_word) == (n, 0, 4 * n - 4)
    assert time.perf_counter() - began < 120  # some 10 s each here; a list copied at each hit took minutes for a fifth of them


def test_keep_one_takes_any_column(spark):
    rows = [(1, "a b c d e f", {"k": 1}, 5, [b"x"]), (2, "a b c d e f", None, 6, None), (3, "other words stand in this one", {}, 7, [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, `m``x` map<string,int>, `_row` int, `a.b` array<binary>")
    made = copies.keep_one(d)
    assert made.columns == d.columns and made.schema["m`x"].dataType == d.schema["m`x"].dataType
    assert sorted((r.doc_id, r["_row"], r["m`x"]) for r in made.collect()) == [(1, 5, {"k": 1}), (3, 7, {})]
    assert copies.keep_one(d.limit(0)).count() == 0
