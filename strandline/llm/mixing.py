"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import n_words
from strandline.session import written

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 42
#: Documents or residuals that one node of the reduction tree pairs.
FAN_IN = 64
#: The table of sources is ranked and shared in one task and broadcast; more sources are an error.
MAX_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, ...) with `target`, doubles that add up to all sizes.

    Sources by code point, null last, weigh as `weights` in turn. A target stops at cap times its
    source's size and the excess is shared by weight among the rest. With sources in order of
    cap x size / weight, the level at which the rest share what capped ones leave is in closed form.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    most = F.col("source_size") * float(cap)
    ranked = ranked.withColumn("fill", most / F.col("w"))
    order = Window.orderBy("fill", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)
    return ranked.withColumn("target", F.least(most, F.coalesce(first["level"] * F.col("w"), most))).drop("rank", "w", "fill", "level")


def _pairing(seed: int) -> str:
    """SQL of the step that pairs x (na: minus its words, h, p, k) with the pool of all elements after it.

    Words move from x to the pool or back until x or the whole pool is integral; which way is drawn so
    that every expectation stays. The pool is known by its words (s0), their expectation at the start
    (s1) and the map alpha x p + beta that the moves so far make of each p. As the largest come first,
    what stays fractional (cur) is as a rule the smallest document; out is what became integral.
    """
    a, p = "(-x.na)", "greatest(0D, least(1D, acc.alpha * x.p + acc.beta))"
    draw = f"(cast(shiftrightunsigned(xxhash64({seed}L, x.h), 11) as double) / 9007199254740992D)"
    rest = f"(acc.s0 - {a})"
    pool = f"greatest(0D, least({rest}, acc.alpha * (acc.s1 - {a} * x.p) + acc.beta * {rest}))"
    room = "(y.rest - y.pool)"
    up, down = "least((1 - y.p) * y.a, y.pool)", f"least(y.p * y.a, {room})"
    rises = f"({draw} * ({up} + {down}) < {down})"
    ends = f"if(y.rises, (1 - y.p) * y.a <= y.pool, y.p * y.a <= {room})"
    kept = f"(1 - if(y.rises, if(y.pool > 0, {up} / y.pool, 0D), if({room} > 0, {down} / {room}, 0D)))"
    state = "named_struct('cur', {}, 'alpha', {}, 'beta', {}, 's0', y.rest, 's1', acc.s1 - y.a * x.p, 'out', {})"
    out = "concat(acc.out, array(named_struct('k', x.k, 'up', {})))"
    item = "named_struct('na', x.na, 'h', x.h, 'p', {}, 'k', x.k)"
    over = state.format("acc.cur", "0D", "acc.beta", out.format("cast(acc.beta as int)"))
    last = state.format(item.format("y.p"), "0D", "0D", "acc.out")
    settled = state.format("acc.cur", f"acc.alpha * {kept}", f"if(y.rises, acc.beta * {kept}, acc.beta * {kept} + 1 - {kept})", out.format("if(y.rises, 1, 0)"))
    open_ = state.format(item.format(f"greatest(0D, least(1D, if(y.rises, y.p + y.pool / y.a, y.p - {room} / y.a)))"), "0D", "if(y.rises, 0D, 1D)", "acc.out")
    step = f"case when acc.cur is not null then {over} when y.rest <= 0 then {last} when {ends} then {settled} else {open_} end"
    one = f"named_struct('a', {a}, 'p', {p}, 'rest', {rest}, 'pool', {pool})"
    two = f"named_struct('a', y.a, 'p', y.p, 'rest', y.rest, 'pool', y.pool, 'rises', {rises})"
    return f"transform(transform(array({one}), y -> {two}), y -> {step})[0]"


def _reduce(level: DataFrame, seed: int, id_type: str) -> DataFrame:
    """One row for each (source, node): out and cur of its elements, largest documents first."""
    k = f"struct<doc_id:{id_type},size:bigint,m:bigint>"
    grouped = level.groupBy("source", "node").agg(F.array_sort(F.collect_list("e")).alias("e"))
    total = "aggregate(e, 0D, (t, x) -> t - x.na{})"
    zero = f"named_struct('cur', cast(null as struct<na:double,h:bigint,p:double,k:{k}>), 'alpha', 1D, 'beta', 0D, 's0', {total.format('')}, 's1', {total.format(' * x.p')}, 'out', cast(array() as array<struct<k:{k},up:int>>))"
    return grouped.select("source", "node", F.expr(f"aggregate(e, {zero}, (acc, x) -> {_pairing(seed)})").alias("s")).select("source", "node", "s.out", "s.cur")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, m, source_size, target, copies) for each distinct (doc_id, source, size).

    size: words of the text, 0 for null. m: rows that are alike in these three; they are one document
    and get the same number of copies. copies is the whole part of target / source_size or one more,
    at most `cap`. The fractions are rounded in pairs: at each node of a tree up to about FAN_IN
    documents of a source, dealt by hash, leave one residual, and residuals meet at the next level
    until each source has one, which is drawn. Words taken of a source miss its target by less than
    that last document, which is a small one wherever small ones can balance the large. All draws hash the seed and doc_ids: reruns agree, however rows are dealt.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    atoms = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    atoms = written(atoms, "sizes")
    sizes = atoms.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("atoms"))
    sizes = written(sizes, "sources")
    n, most = sizes.agg(F.count("*"), F.max("atoms")).first()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} can be mixed")
    rates = targets(sizes, weights, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0))
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    rated = atoms.join(F.broadcast(rates), atoms.source.eqNullSafe(rates.source)).drop(rates.source)
    settled = (F.col("size") == 0) | (F.col("part") == 0)
    fixed = rated.where(settled).select("doc_id", "source", "size", "m", "source_size", "target", F.col("whole").alias("copies"))
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "source")
    level = rated.where(~settled).select(
        "source",
        F.pmod(h, F.ceil(F.col("atoms") / FAN_IN)).alias("node"),
        F.struct((-F.col("size") * F.col("m")).cast("double").alias("na"), h.alias("h"), F.col("part").alias("p"), F.struct("doc_id", "size", "m").alias("k")).alias("e"),
    )
    rounded, nodes, depth = None, -(-(most or 1) // FAN_IN), 0
    while True:
        depth += 1
        made = written(_reduce(level, seed + depth, id_type), "level")
        out = made.select("source", F.explode("out").alias("o")).select("source", "o.k.*", "o.up")
        rounded = out if rounded is None else rounded.unionByName(out)
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN_IN)
        level = made.select("source", F.floor(F.col("node") / FAN_IN).alias("node"), F.col("cur").alias("e"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("cur.h")), 11).cast("double") / 2.0**53
    rounded = rounded.unionByName(made.select("source", "cur.k.*", (draw < F.col("cur.p")).cast("int").alias("up")))
    few = rates.select(F.col("source").alias("_s"), "source_size", "target", "whole")
    drawn = rounded.join(F.broadcast(few), rounded.source.eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "m", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))
    return fixed.unionByName(drawn)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs.

    taken = copies x size. Null texts have size 0; null is a source, the last; repeated rows each
    get a row; without rows the result is empty.
    """
    found = copies(docs, weights, cap, seed)
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.explode(F.expr("sequence(1L, m)")).alias("_n")
    ).drop("_n")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with `mix_copy` from 1 (in place of a column of that name); documents without words are not taken."""
    chosen = copies(docs, weights, cap, seed).where((F.col("copies") > 0) & (F.col("size") > 0)).select("doc_id", "source", "size", "copies")
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("words"))
    row = F.col("row")
    same = row["doc_id"].eqNullSafe(chosen["doc_id"]) & row["source"].eqNullSafe(chosen["source"]) & (F.col("words") == chosen["size"])
    drawn = rows.join(chosen, same).select("row", F.explode(F.expr("sequence(1L, copies)")).alias("mix_copy"))
    return drawn.select(*[row.getField(c).alias(c) for c in docs.columns if c.lower() != "mix_copy"], "mix_copy")
