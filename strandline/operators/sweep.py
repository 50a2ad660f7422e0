"""Stabbing intervals without lists of them: sorted ends, covers of dyadic nodes, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import quoted
from strandline.operators.scan import filled, running_sum
from strandline.session import written

#: Levels of the dyadic tree that one join pushes down; a node has 2^STRATUM descendants there at most.
STRATUM = 10


def asof(rows: DataFrame, events: DataFrame, by: str, at: str, out: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """rows with the newest event (column `event` of events: by, at, event) of the same `by` that isn't later, or the next that isn't earlier (forward).

    strict: nor at the same time. Events are laid among the rows and carried along, so neither a key's rows nor its events meet in one task; of
    events of one time any may be taken, so they should be one. Rows of one time are told apart, so that they needn't share a task either.
    """
    sign = -1.0 if forward else 1.0
    place = sign * F.col(at).cast("double")
    told = rows.select(F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("_row"), F.col(by).alias("_k"), place.alias("_at"), F.lit(1 - 2 * int(strict)).alias("_z"), F.monotonically_increasing_id().alias("_n"))
    laid = told.unionByName(events.select(F.col(by).alias("_k"), place.alias("_at"), F.lit(0).alias("_z"), F.lit(0).cast("long").alias("_n"), "event"), allowMissingColumns=True)
    return filled(laid, F.col("event"), ["_k"], ["_at", "_z", "_n"], "_found").where(F.col("_row").isNotNull()).select("_row.*", F.col("_found").alias(out))


def _covers(spans: DataFrame, levels: int) -> DataFrame:
    """(token, level, node, best, rival) from spans: token, low, high (exclusive), width, rid: the largest dyadic nodes within each span, and of each node the narrowest span.

    best, rival: the narrowest span with the smallest and the largest rid; two ids if more than one span is as narrow.
    """
    up = lambda x, level: F.floor((x + F.pow(F.lit(2.0), level) - 1) / F.pow(F.lit(2.0), level)).cast("long")
    down = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level)).cast("long")
    each = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    each = each.withColumns({"_a": up(F.col("low"), F.col("level")), "_z": down(F.col("high"), F.col("level"))}).withColumns({"_pa": up(F.col("low"), F.col("level") + 1), "_pz": down(F.col("high"), F.col("level") + 1)})
    inside = lambda k: (F.floor(k / 2) >= F.col("_pa")) & (F.floor(k / 2) < F.col("_pz"))
    ends = F.array_distinct(F.array(F.col("_a"), F.col("_z") - 1))
    nodes = F.filter(ends, lambda k: (k >= F.col("_a")) & (k < F.col("_z")) & ~inside(k))
    return each.select("token", "level", F.explode(nodes).alias("node"), F.struct("width", "rid").alias("best"), F.struct("width", (-F.col("rid")).alias("rid")).alias("rival")).groupBy("token", "level", "node").agg(F.min("best").alias("best"), F.min("rival").alias("rival"))


def _narrowest(spans: DataFrame, pieces: DataFrame, levels: int) -> DataFrame:
    """(token, piece, best, rival): for each piece the narrowest span over it. Nodes are handed down in strata, so no node meets more than 2^STRATUM of what lies below."""
    nodes = written(_covers(spans, levels), "nodes")
    above = None
    for s in range(levels // STRATUM, -1, -1):
        low = s * STRATUM
        blocks = pieces.select("token", F.floor(F.col("piece") / F.lit(2.0**low)).cast("long").alias("block")).distinct()
        each = blocks.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(min(low + STRATUM - 1, levels)))))
        each = each.withColumn("node", F.floor(F.col("block") / F.pow(F.lit(2.0), F.col("level") - low)).cast("long"))
        found = each.join(nodes, ["token", "level", "node"]).select("token", "block", "best", "rival")
        if above is not None:
            parent = blocks.withColumn("node", F.floor(F.col("block") / 2.0**STRATUM).cast("long"))
            found = found.unionByName(parent.join(above.withColumnRenamed("block", "node"), ["token", "node"]).select("token", "block", "best", "rival"))
        above = written(found.groupBy("token", "block").agg(F.min("best").alias("best"), F.min("rival").alias("rival")), "covers")
    return above.withColumnRenamed("block", "piece")


def nearest(samples: DataFrame, intervals: DataFrame, tolerance: float) -> DataFrame:
    """samples (token, t and more) with `best`: the interval of their token that is nearest in time, within the tolerance, else null.

    intervals: token, first, last, key, place, relation. best: distance, width, centre, key, place, relation; the least of these in that order.
    The ends of a token's intervals cut its time into points and gaps. The narrowest interval over each comes from a cover of dyadic nodes; where several are as
    narrow, the one with the nearest centre does, found among those of that width. Outside all intervals the nearest end and the nearest start decide.
    However many intervals overlap, nothing is gathered: there are some four rows for each end, and a sample meets one.
    """
    told = written(intervals.withColumns({"width": F.col("last") - F.col("first"), "rid": F.monotonically_increasing_id()}), "intervals")
    kept = ["key", "place", "relation", "first", "last"]
    ends = told.select("token", F.explode(F.array("first", "last", F.lit(float("-inf")))).alias("p")).distinct()
    ends = written(running_sum(ends, F.lit(1).cast("long"), ["token"], ["p"], "i"), "ends")
    most = ends.agg(F.max("i")).first()[0]
    if most is None:
        nothing = F.struct(F.lit(0.0).alias("distance"), F.lit(0.0).alias("width"), F.lit(0.0).alias("centre"), *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("key", "place", "relation")])
        return samples.withColumn("best", F.when(F.lit(False), nothing))
    levels = (2 * most + 1).bit_length()
    spans = told.join(ends.select("token", F.col("p").alias("first"), F.col("i").alias("a")), ["token", "first"]).join(ends.select("token", F.col("p").alias("last"), F.col("i").alias("b")), ["token", "last"])
    spans = spans.select("token", (2 * F.col("a")).alias("low"), (2 * F.col("b") + 1).alias("high"), "width", "rid")  # a point is 2 i, the gap after it 2 i + 1
    pieces = ends.select("token", F.explode(F.array(2 * F.col("i"), 2 * F.col("i") + 1)).alias("piece"))
    over = _narrowest(spans, pieces, levels)
    alone = F.col("best.rid") == -F.col("rival.rid")
    over = over.select("token", "piece", F.col("best.width").alias("width"), F.when(alone, F.col("best.rid")).alias("rid"))
    over = over.join(told.select("rid", F.struct(*kept).alias("only")), "rid", "left").select("token", "piece", F.struct("width", "only").alias("over"))
    least = F.min(F.struct("width", *kept)).alias("event")
    closed = told.groupBy("token", F.col("last").alias("p")).agg(least)
    opened = told.groupBy("token", F.col("first").alias("p")).agg(least)
    marks = asof(asof(ends, closed, "token", "p", "before"), opened, "token", "p", "after", forward=True, strict=True)
    marks = _with_pieces(marks, over)
    events = marks.select("token", F.col("p").alias("t"), F.struct("p", "before", "after", "point", "gap").alias("event"))
    met = asof(samples, events, "token", "t", "_mark")
    met = met.withColumn("_over", F.when(F.col("t") == F.col("_mark.p"), F.col("_mark.point")).otherwise(F.col("_mark.gap")))
    crowd = F.col("_over").isNotNull() & F.col("_over.only").isNull()
    met = written(met, "met")
    clear = met.where(~crowd).withColumns({"_left": F.col("_over.only"), "_right": F.col("_over.only")})
    wide = met.where(crowd).withColumn("_tw", F.struct("token", F.col("_over.width").alias("width")))
    middle = ((F.col("first") + F.col("last")) / 2).alias("t")
    centres = told.groupBy(F.struct("token", "width").alias("_tw"), middle).agg(F.min(F.struct(*kept)).alias("event"))
    wide = asof(asof(wide, centres, "_tw", "t", "_left"), centres, "_tw", "t", "_right", forward=True).drop("_tw")
    t = F.col("t")

    def ranked(r: Column) -> Column:
        outside = F.when((r["first"] <= t) & (t <= r["last"]), 0.0).otherwise(F.least(F.abs(t - r["first"]), F.abs(t - r["last"])))
        return F.when(r.isNotNull(), F.struct(outside.alias("distance"), (r["last"] - r["first"]).alias("width"), F.abs(t - (r["first"] + r["last"]) / 2).alias("centre"), r["key"].alias("key"), r["place"].alias("place"), r["relation"].alias("relation")))

    tried = F.array(*[ranked(F.col(c)) for c in ("_left", "_right", "_mark.before", "_mark.after")])
    best = F.array_min(F.filter(tried, lambda c: c.isNotNull() & (c["distance"] <= tolerance)))
    return clear.unionByName(wide).select(*[F.col(quoted(c)) for c in samples.columns], best.alias("best"))


def _with_pieces(marks: DataFrame, over: DataFrame) -> DataFrame:
    """marks with the cover of their point and of the gap after it."""
    even = F.col("piece") % 2 == 0
    both = over.groupBy("token", F.floor(F.col("piece") / 2).cast("long").alias("i")).agg(F.max_by("over", F.when(even, 1)).alias("point"), F.max_by("over", F.when(~even, 1)).alias("gap"))
    return marks.join(both, ["token", "i"], "left")
