"""Fuzzy matching of names: entity tokens and schemas."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.schema import ALIASES, canonical_name
from strandline.session import written


#: Characters that a token may lack at most to be found by what is left, and texts that are left then.
DELETED, VARIANTS = 3, 400


def _score(a: str | None, b: str | None, least: float) -> float | None:
    """Share of characters in matching blocks (Ratcliff-Obershelp); null where the characters in common show that it is below `least`."""
    if a is None or b is None:
        return None
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.quick_ratio() >= least else None


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([_score(x, y, z) for x, y, z in zip(a, b, least, strict=True)], dtype="float64")


def _needed(total: Column, q: int, threshold: float) -> Column:
    """q-grams that two tokens of `total` characters together share at least, if their ratio reaches the threshold.

    A ratio r of lengths a and b means M = r (a + b) / 2 characters in matching blocks, which stand in the same order in both. Each of the a - M others of the one
    breaks q of its q-grams at most, each of the b - M of the other, by standing between two, q - 1; so a - q + 1 - q (a - M) - (q - 1) (b - M) are
    left, which is (2 q - 1) M - (q - 1) (a + b + 1).
    """
    return F.ceil(total * ((2 * q - 1) * threshold / 2 - (q - 1)) - (q - 1) - 1e-9)


def _grams(tokens: DataFrame, name: str, q: int) -> DataFrame:
    """(name, n, gram): the q-grams of each token, the k-th time a q-gram stands there with its k."""
    n = F.length(name)
    at = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(F.col(name), i, F.lit(q)))
    each = tokens.where(n >= q).select(name, n.alias("n"), F.explode(at).alias("g")).groupBy(name, "n", "g").agg(F.count("*").alias("c"))
    return each.select(name, "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("c")), lambda k: F.struct(F.col("g"), k.alias("k")))).alias("gram"))


def _prefixes(grams: DataFrame, often: DataFrame, name: str, q: int, threshold: float) -> DataFrame:
    """Of each token its rarest grams, one more than it may lack: two tokens that share enough grams share one of these."""
    bound = threshold / (2 - threshold)
    shortest = F.greatest(F.ceil(F.col("n") * bound - 1e-9), F.lit(1))  # of the tokens whose ratio with this one can reach the threshold
    kept = F.col("n") - q + 1 - F.greatest(_needed(F.col("n") + shortest, q, threshold), F.lit(1)) + 1
    place = F.row_number().over(Window.partitionBy(name).orderBy("f", "gram"))
    return grams.join(often, "gram", "left").withColumn("f", F.coalesce("f", F.lit(0))).withColumn("place", place).where(F.col("place") <= kept).select(name, "n", "gram")


def _common(a: Column, b: Column, threshold: float) -> Column:
    """Characters in matching blocks of two tokens of a and b characters, at least, if their ratio reaches the threshold."""
    return F.ceil((a + b) * (threshold / 2) - 1e-9)


def _ways(n: Column, k: Column) -> Column:
    """Subsequences of n - k of n characters, by place; null if k is more than DELETED."""
    made = F.lit(1).cast("long")
    found = F.when(k == 0, made)
    for i in range(1, DELETED + 1):
        made = F.floor(made * (n - i + 1) / i)
        found = found.when(k == i, made)
    return found


def _easy(a: Column, b: Column, threshold: float) -> Column:
    """Whether pairs of tokens of a and b characters are found by what is left when each lacks a few."""
    m = _common(a, b, threshold)
    return F.coalesce((_ways(a, a - m) <= VARIANTS) & (_ways(b, b - m) <= VARIANTS) & (m > 0), F.lit(False))


def _variants(tokens: DataFrame, name: str, lacks: DataFrame) -> DataFrame:
    """(name, n, rest): each token without each choice of k of its characters; lacks: n and k for the lengths there are."""
    one = "array_distinct(flatten(transform(made, s -> transform(sequence(1, length(s)), i -> concat(substring(s, 1, i - 1), substring(s, i + 1))))))"
    rests = F.expr(f"aggregate(sequence(0, k), array({name}), (made, i) -> if(i = 0, made, {one}))")
    return tokens.withColumn("n", F.length(name)).join(F.broadcast(lacks), "n").select(name, "n", F.explode(rests).alias("rest"))


def _by_variants(wanted: DataFrame, known: DataFrame, lengths: DataFrame, threshold: float) -> DataFrame:
    """(token, match): a ratio of r over a + b characters means r (a + b) / 2 in common in the same order, so both give the same text when each lacks its others."""
    m = _common(F.col("a"), F.col("b"), threshold)
    x = _variants(wanted, "token", lengths.select(F.col("a").alias("n"), (F.col("a") - m).cast("int").alias("k")).distinct()).withColumnRenamed("n", "a")
    y = _variants(known, "match", lengths.select(F.col("b").alias("n"), (F.col("b") - m).cast("int").alias("k")).distinct()).withColumnRenamed("n", "b")
    exact = (F.length("rest") == m) & _easy(F.col("a"), F.col("b"), threshold)
    return x.join(y, "rest").where(exact).select("token", "match").distinct()


def candidates(wanted: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(token, match): every pair of wanted (token) and known (match) whose ratio can reach the threshold, and others.

    Tokens that may lack few characters, so that there are no more than VARIANTS texts without them, meet in such a text: then the number of pairs grows with
    those that are alike, however many tokens share most of their q-grams, as numbered names do. Other pairs are found by bigrams, or by characters where tokens are so short, or the
    threshold so low (two thirds), that bigrams prove nothing; rare ones are looked up first (a prefix filter). A pair shares a character at least.
    """
    threshold = max(threshold, 1e-6)
    share = 1.5 * threshold - 1
    short = int(1 / share + 1e-9) if share > 1e-9 else 1 << 30  # lengths that together are no more have no bigram they must share
    a, b = F.col("a"), F.col("b")
    total = a + b
    fits = 2 * F.least(a, b) >= threshold * total - 1e-9
    sizes = lambda df, name, n: df.select(F.length(name).alias(n)).where(F.col(n) > 0).distinct()
    lengths = written(sizes(wanted, "token", "a").join(F.broadcast(sizes(known, "match", "b")), fits), "lengths", rows=1)
    easy, hard = lengths.where(_easy(a, b, threshold)), lengths.where(~_easy(a, b, threshold))
    found = _by_variants(wanted, known, easy, threshold)
    for q in (1, 2):
        left_over = hard.where(total <= short if q == 1 else total > short)
        if left_over.isEmpty():
            continue
        among = lambda df, name, n: df.join(F.broadcast(left_over.select(F.col(n).alias("_n")).distinct()), F.length(name) == F.col("_n"), "left_semi")  # noqa: B023, E731
        left, right = _grams(among(wanted, "token", "a"), "token", q), _grams(among(known, "match", "b"), "match", q)
        often = right.groupBy("gram").agg(F.count("*").alias("f"))
        x = _prefixes(left, often, "token", q, threshold).withColumnRenamed("n", "a")
        y = _prefixes(right, often, "match", q, threshold).withColumnRenamed("n", "b")
        kept = fits & (total <= short if q == 1 else total > short) & ~_easy(a, b, threshold)
        found = found.unionByName(x.join(y, "gram").where(kept).select("token", "match").distinct())
    return found


def fuzzy_tokens(wanted: DataFrame, known: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(token, match, score): for each wanted token that isn't known its best known ones, all that tie, from the threshold.

    wanted, known: one column `token`. Only pairs are scored that `candidates` can't rule out; tokens without a common character don't match.
    """
    left = wanted.where(F.col("token") != "").distinct().join(known.select("token"), "token", "left_anti")
    right = known.where(F.col("token") != "").distinct().select(F.col("token").alias("match"))
    scored = candidates(left, right, threshold).withColumn("score", similarity("token", "match", F.lit(threshold))).where(F.col("score") >= threshold)
    # the best score, then what has it: pairs of a token may be many, so they aren't gathered
    scored = written(scored, "scored")
    best = scored.groupBy("token").agg(F.max("score").alias("best"))
    return scored.join(best, "token").where(F.col("score") == F.col("best")).select("token", "match", "score")


def match_schemas(source: list[str], target: list[str], accept: float = 0.75) -> list[dict]:
    """For each source name its best target: confidence 1 for one canonical name, else three quarters for shared aliases and a quarter of the similarity; ties go to the larger name."""
    found = []
    for name in source:
        scored = []
        for other in target:
            lexical = SequenceMatcher(None, name.strip().lower(), other.strip().lower()).ratio()
            alias = any(name.lower() in a and other.lower() in a for a in ALIASES.values())
            scored.append((1.0 if canonical_name(name) == canonical_name(other) else 0.75 * alias + 0.25 * lexical, other))
        if scored:
            confidence, other = max(scored)
            found.append({"source": name, "target": other, "confidence": round(confidence, 4), "accepted": confidence >= accept})
    return found
