"""Alignment of samples with the intervals of their entity, and fusion of both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.schema import canonical_columns
from strandline.functions.values import entity_token, finite
from strandline.operators.matching import fuzzy_tokens
from strandline.operators.scan import lagged
from strandline.operators.sweep import asof, nearest
from strandline.session import written

#: Relations of a token that a bucket holds at most as a list; buckets that one of them may span.
CROWD, SPAN = 256, 64
REASONS = ("hit", "outside tolerance", "entity not found", "missing entity", "bad timestamp")


def _number(df: DataFrame, *names: str) -> Column:
    kinds = dict(df.dtypes)
    found = [finite(F.col(n), kinds[n]) for n in names if n in kinds]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def prepare_relations(relations: DataFrame, order: str | None = None) -> DataFrame:
    """token, first, last, ok, key, order and the relation as a struct; not ok: no entity, no finite bounds, or end before start."""
    relations = canonical_columns(relations)
    public = [c for c in relations.columns if not c.startswith("_") and c != order]
    whole = F.struct(*public)
    token = entity_token(F.col("equipment_id")) if "equipment_id" in relations.columns else F.lit("")
    first = _number(relations, "start_ms", "timestamp_ms")
    made = relations.select(token.alias("token"), first.alias("first"), whole.alias("relation"), *([F.col(order).cast("long").alias("place")] if order else [F.xxhash64(*public).alias("place")]), F.coalesce(_number(relations, "end_ms"), first).alias("last"))
    key = F.col("relation.work_order").cast("string") if "work_order" in public else F.to_json("relation")
    ok = (F.col("token") != "") & F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("last") >= F.col("first"))
    return made.withColumn("key", F.coalesce(key, F.to_json("relation"))).withColumn("ok", F.coalesce(ok, F.lit(False)))


def align(sequence: DataFrame, relations: DataFrame, tolerance_ms: float = 1200.0, fuzzy_threshold: float | None = 0.88, relation_order: str | None = None, bucket_ms: float | None = None, crowd: int = CROWD) -> DataFrame:
    """Each row of sequence with the relation whose closed interval is nearest in time, within the tolerance.

    Columns are canonical: equipment_id and timestamp_ms here, equipment_id, start_ms and end_ms there
    (timestamp_ms for a missing start, the start for a missing end). Entities match by token, else by the most similar token
    from fuzzy_threshold (None: exactly only). The best has the least distance, then width, distance from the
    centre, work order as text, and place in relation_order (else a hash of its columns).
    Adds aligned, alignment_distance_ms, alignment_reason, entity_match, relation, invalid_relation_count; no row is lost.

    Relations are gathered by token and time bucket, so a sample meets one row with all that may hold it:
    one left join that keeps rows as they are, without a row for each candidate. Buckets default to the
    median width of an interval with its tolerance. A token with more than `crowd` relations in a bucket, or with one over more than SPAN buckets, is
    swept instead (`sweep.nearest`), with the same result: nothing of it is gathered, however many of its relations overlap.
    """
    if not (math.isfinite(tolerance_ms) and tolerance_ms >= 0):
        raise ValueError("the tolerance must be finite and not negative")
    if fuzzy_threshold is not None and not 0 <= fuzzy_threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    sequence = canonical_columns(sequence)
    told = prepare_relations(relations, relation_order)
    good = told.where("ok").drop("ok")
    invalid = told.agg(F.count_if(~F.col("ok")).alias("invalid_relation_count"))
    token = entity_token(F.col("equipment_id")) if "equipment_id" in sequence.columns else F.lit("")
    rows = sequence.withColumn("_token", token).withColumn("_t", _number(sequence, "timestamp_ms"))
    kinds = good.select("token").distinct().withColumn("entity_match", F.lit("exact"))
    if fuzzy_threshold is not None:
        usable = rows.where((F.col("_token") != "") & F.col("_t").isNotNull()).select(F.col("_token").alias("token")).distinct()
        near = fuzzy_tokens(usable, kinds.select("token"), fuzzy_threshold)
        kinds = kinds.unionByName(near.select("token").distinct().withColumn("entity_match", F.lit("fuzzy")))
        renamed = good.join(near.select(F.col("token").alias("_from"), F.col("match").alias("token")), "token").withColumn("token", F.col("_from")).drop("_from")
        good = good.unionByName(renamed)
    width = F.col("last") - F.col("first")
    each = good.groupBy("token").agg(F.count("*").alias("n"), F.percentile_approx(width, 0.5).alias("typical"), F.max(width).alias("longest"))
    most, typical, longest = each.agg(F.max("n"), F.percentile_approx("typical", 0.5), F.max("longest")).first()
    bucket_ms = bucket_ms if bucket_ms is not None else max((typical or 0.0) + 2 * tolerance_ms, 1.0)
    lists = (most or 0) <= crowd and (longest or 0.0) + 2 * tolerance_ms < (SPAN - 2) * bucket_ms  # then no bucket holds more, none spans more
    low, high = F.floor((F.col("first") - tolerance_ms) / bucket_ms), F.floor((F.col("last") + tolerance_ms) / bucket_ms)
    good = good.withColumns({"_low": low, "_high": high})
    some = False
    if not lists:
        short = F.col("_high") - F.col("_low") < SPAN
        many = good.where(short).select("token", F.explode(F.sequence("_low", "_high")).alias("bucket")).groupBy("token", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
        swept = written(many.select("token").unionByName(good.where(~short).select("token")).distinct(), "swept")
        some = not swept.isEmpty()
    listed = good.join(swept, "token", "left_anti") if some else good
    gathered = listed.withColumn("bucket", F.explode(F.sequence("_low", "_high"))).groupBy(F.col("token").alias("_of"), F.col("bucket").alias("_in")).agg(F.collect_list(F.struct("first", "last", "key", "place", "relation")).alias("_near"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms))
    met = rows.join(gathered, (F.col("_token") == F.col("_of")) & (F.col("_bucket") == F.col("_in")), "left").drop("_of", "_in")
    kinds = kinds.join(swept.withColumn("_swept", F.lit(True)), "token", "left") if some else kinds.withColumn("_swept", F.lit(None).cast("boolean"))
    met = met.join(kinds.withColumnRenamed("token", "_kind"), F.col("_token") == F.col("_kind"), "left").drop("_kind")
    t = F.col("_t")

    def ranked(r: Column) -> Column:
        outside = F.when((r["first"] <= t) & (t <= r["last"]), 0.0).otherwise(F.least(F.abs(t - r["first"]), F.abs(t - r["last"])))
        return F.struct(outside.alias("distance"), (r["last"] - r["first"]).alias("width"), F.abs(t - (r["first"] + r["last"]) / 2).alias("centre"), r["key"].alias("key"), r["place"].alias("place"), r["relation"].alias("relation"))

    best = F.array_min(F.filter(F.transform(F.col("_near"), ranked), lambda c: c["distance"] <= tolerance_ms))
    met = met.withColumn("_best", best)
    if some:
        met = written(met.drop("_near", "_bucket"), "met")
        crowded = F.coalesce(F.col("_swept"), F.lit(False)) & t.isNotNull()
        asked = met.where(crowded).drop("_best").select(F.col("_token").alias("token"), t.alias("t"), F.struct("*").alias("_row"))
        found = nearest(asked, good.join(swept, "token", "left_semi").drop("_low", "_high"), tolerance_ms)
        met = met.where(~crowded).unionByName(found.select("_row.*", F.col("best").alias("_best")))
    reason = (
        F.when(F.col("_token") == "", REASONS[3]).when(t.isNull(), REASONS[4]).when(F.col("_best").isNotNull(), REASONS[0])
        .when(F.col("entity_match").isNull(), REASONS[2]).otherwise(REASONS[1])
    )
    usable = (F.col("_token") != "") & t.isNotNull()
    return met.crossJoin(F.broadcast(invalid)).select(  # one row: the count of invalid relations
        *sequence.columns,
        F.col("_best").isNotNull().alias("aligned"),
        F.round("_best.distance", 3).alias("alignment_distance_ms"),
        reason.alias("alignment_reason"),
        F.when(usable, F.coalesce("entity_match", F.lit("none"))).otherwise("none").alias("entity_match"),
        F.col("_best.relation").alias("relation"),
        "invalid_relation_count",
    )


def fuse(sequence: DataFrame, relations: DataFrame, tolerance_ms: float = 1000.0, **more) -> DataFrame:
    """align() with the relation's fields as columns relation_<name>; unmatched rows stay, with nulls there."""
    found = align(sequence, relations, tolerance_ms, **more)
    fields = found.schema["relation"].dataType.names
    kept = [c for c in found.columns if c != "relation"]
    return found.select(*kept, *[F.col(f"relation.`{f}`").alias(f"relation_{f}") for f in fields])


def label_by_interval(rows: DataFrame, intervals: DataFrame, t: str = "timestamp_ms", label: str = "work_order") -> DataFrame:
    """rows with the label of the one closed interval [start_ms, end_ms] that holds them, null outside; overlapping intervals are an error.

    Intervals without bounds, or that end before they start, hold nothing. Sorted by start, each must begin after the greatest end before it; then a row can only lie in the one
    that began last, which a scan of starts and rows carries along. So neither a long interval nor many in one place make a list.
    """
    sound = written(intervals.where(F.col("start_ms") <= F.col("end_ms")).select(F.lit(0).alias("_by"), F.col("start_ms").cast("double").alias("_a"), F.col("end_ms").cast("double").alias("_z"), F.col(label).alias("_l")), "intervals")
    if not lagged(sound, F.col("_z"), ["_by"], ["_a", "_z"]).where(F.col("_a") <= F.col("lag_1")).isEmpty():
        raise ValueError("intervals overlap")  # if none begins before the one before it has ended, none begins before any has
    events = sound.select("_by", F.col("_a").alias("_at"), F.struct(F.col("_z").alias("z"), F.col("_l").alias("l")).alias("event"))
    met = asof(rows.withColumns({"_by": F.lit(0), "_at": F.col(t).cast("double")}), events, "_by", "_at", "_hit")
    return met.withColumn("label", F.when(F.col("_at") <= F.col("_hit.z"), F.col("_hit.l"))).drop("_by", "_at", "_hit")
