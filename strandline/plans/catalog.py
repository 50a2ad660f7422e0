"""The engine's queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.codecs import frames
from strandline.functions import values as V
from strandline.functions.schema import canonical_columns
from strandline.operators import align as A
from strandline.operators import govern as G
from strandline.operators import quality as Q
from strandline.operators import store as S
from strandline.operators import truth as T
from strandline.operators import windows as W
from strandline.operators.matching import fuzzy_tokens, match_schemas
from strandline.session import shared_dir, table, written
from strandline.sources import files, quarantine, series
from strandline.sources.text import parse_payloads, sniffed
from strandline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Inputs, in both languages.

MS = "CAST(round_even(epoch_us(ts) / 1000.0, 0) AS BIGINT)"
SEQ = f"SELECT event_id AS source_index, CAST(user_id AS VARCHAR) AS equipment_id, {MS} AS timestamp_ms, value FROM events"
HOLED = f"SELECT event_id AS source_index, CASE WHEN event_id % 103 <> 0 THEN CAST(user_id AS VARCHAR) END AS equipment_id, CASE WHEN event_id % 101 <> 0 THEN {MS} END AS timestamp_ms, value FROM events"
REL = f"SELECT CAST(user_id AS VARCHAR) AS equipment_id, {MS} - 21600000 * (1 + event_id % 4) AS start_ms, CASE WHEN event_id % 17 = 0 THEN {MS} - 21600000 * (1 + event_id % 4) - 1 ELSE {MS} + 21600000 * (1 + event_id % 4) END AS end_ms, event_id AS work_order FROM events WHERE event_type = 'error' AND user_id % 10 <> 0"


def sequence(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entity, t = F.col("user_id").cast("string"), V.epoch_ms(F.col("ts"))
    if holes:
        entity, t = F.when(F.col("event_id") % 103 != 0, entity), F.when(F.col("event_id") % 101 != 0, t)
    return e.select(F.col("event_id").alias("source_index"), entity.alias("equipment_id"), t.alias("timestamp_ms"), "value")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("user_id") % 10 != 0))
    t, half = V.epoch_ms(F.col("ts")), (1 + F.col("event_id") % 4) * 6 * HOUR
    end = F.when(F.col("event_id") % 17 == 0, t - half - 1).otherwise(t + half)
    return e.select(F.col("user_id").cast("string").alias("equipment_id"), (t - half).alias("start_ms"), end.alias("end_ms"), F.col("event_id").alias("work_order"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align(sequence(spark, sf_dir, True), relations(spark, sf_dir), HOUR, None)


BEST = f"""
WITH s AS ({HOLED}), r AS ({REL}), good AS (SELECT * FROM r WHERE end_ms >= start_ms),
cand AS (
  SELECT s.source_index, good.work_order, good.start_ms, good.end_ms,
    CASE WHEN s.timestamp_ms BETWEEN good.start_ms AND good.end_ms THEN 0.0 ELSE least(abs(s.timestamp_ms - good.start_ms), abs(s.timestamp_ms - good.end_ms)) END AS distance,
    good.end_ms - good.start_ms AS width, abs(s.timestamp_ms - (good.start_ms + good.end_ms) / 2.0) AS centre
  FROM s JOIN good ON s.equipment_id = good.equipment_id AND s.timestamp_ms BETWEEN good.start_ms - 3600000 AND good.end_ms + 3600000),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY source_index ORDER BY distance, width, centre, CAST(work_order AS VARCHAR)) = 1),
al AS (
  SELECT s.*, best.source_index IS NOT NULL AS aligned, best.work_order, CAST(best.distance AS DOUBLE) AS distance, best.start_ms, best.end_ms,
    CASE WHEN s.equipment_id IS NULL THEN 'missing entity' WHEN s.timestamp_ms IS NULL THEN 'bad timestamp' WHEN best.source_index IS NOT NULL THEN 'hit'
         WHEN s.equipment_id NOT IN (SELECT equipment_id FROM good) THEN 'entity not found' ELSE 'outside tolerance' END AS reason,
    (SELECT count(*) FROM r WHERE end_ms < start_ms) AS invalid
  FROM s LEFT JOIN best ON s.source_index = best.source_index)
"""


@query(BEST + "SELECT source_index, aligned, work_order, distance AS alignment_distance_ms, reason AS alignment_reason, CASE WHEN reason IN ('hit', 'outside tolerance') THEN 'exact' ELSE 'none' END AS entity_match, invalid AS invalid_relation_count FROM al")
def align_best_window(spark, sf_dir):
    return _aligned(spark, sf_dir).select("source_index", "aligned", F.col("relation.work_order").alias("work_order"), "alignment_distance_ms", "alignment_reason", "entity_match", "invalid_relation_count")


@query(BEST + "SELECT source_index, equipment_id, timestamp_ms, value, aligned, work_order AS relation_work_order, start_ms AS relation_start_ms, end_ms AS relation_end_ms FROM al")
def fuse_left_preserve(spark, sf_dir):
    made = A.fuse(sequence(spark, sf_dir, True), relations(spark, sf_dir), HOUR, fuzzy_threshold=None)
    return made.select("source_index", "equipment_id", "timestamp_ms", "value", "aligned", "relation_work_order", "relation_start_ms", "relation_end_ms")


#: Machines by name; every other sample has a letter too many, and so matches the relation's name by 28 of 29 characters.
_NAMED = BEST.replace(HOLED, f"SELECT source_index, CASE WHEN equipment_id IS NOT NULL THEN lpad(equipment_id, 13, 'machine000000') END AS equipment_id, timestamp_ms, value FROM ({HOLED})").replace(f"r AS ({REL})", f"r AS (SELECT * REPLACE (lpad(equipment_id, 13, 'machine000000') AS equipment_id) FROM ({REL}))")


@query(_NAMED + "SELECT source_index, work_order, reason AS alignment_reason, CASE WHEN reason NOT IN ('hit', 'outside tolerance') THEN 'none' WHEN source_index % 2 = 0 THEN 'fuzzy' ELSE 'exact' END AS entity_match FROM al")
def align_fuzzy_entities(spark, sf_dir):
    name = F.lpad("equipment_id", 13, "machine000000")
    s = sequence(spark, sf_dir, True).withColumn("equipment_id", F.when(F.col("source_index") % 2 == 0, F.concat(name, F.lit(" X"))).otherwise(name))
    made = A.align(s, relations(spark, sf_dir).withColumn("equipment_id", name), HOUR, 0.95)
    return made.select("source_index", F.col("relation.work_order").alias("work_order"), "alignment_reason", "entity_match")


@query(BEST + "SELECT reason AS alignment_reason, count(*) AS n FROM al GROUP BY 1")
def align_reason_counts(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("alignment_reason").agg(F.count("*").alias("n"))


@query(f"WITH s AS ({SEQ}), w AS (SELECT event_id AS work_order, {MS} - 1000 AS start_ms, {MS} + 1000 AS end_ms FROM events WHERE event_id % 500 = 0) SELECT s.source_index, w.work_order AS label FROM s LEFT JOIN w ON s.timestamp_ms BETWEEN w.start_ms AND w.end_ms")
def theta_truth_label(spark, sf_dir):
    t = V.epoch_ms(F.col("ts"))
    w = table(spark, sf_dir, "events").where(F.col("event_id") % 500 == 0).select(F.col("event_id").alias("work_order"), (t - 1000).alias("start_ms"), (t + 1000).alias("end_ms"))
    return A.label_by_interval(sequence(spark, sf_dir), w).select("source_index", "label")


@query(BEST + ", c AS (SELECT count(*) AS n, count_if(aligned) AS hits, count_if(aligned AND distance = 0) AS inside FROM al) SELECT n, hits, inside, greatest(0.0, round(100 * ((hits / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n)), 2)) AS low FROM c")
def align_accuracy_wilson(spark, sf_dir):
    c = _aligned(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("aligned").alias("hits"), F.count_if(F.col("alignment_distance_ms") == 0).alias("inside"))
    return c.select("n", "hits", "inside", F.round(V.wilson(F.col("hits"), F.col("n"))[0], 2).alias("low"))


_NEAR = f"SELECT event_id AS work_order, user_id, {MS} - 1000 AS start_ms, {MS} + 1000 AS end_ms FROM events WHERE event_id % 500 = 0"


@query(f"""WITH w AS ({_NEAR}), s AS (SELECT event_id AS i, user_id, {MS} AS ms FROM events),
p AS (SELECT s.i, t.work_order AS truth, q.work_order AS predicted, s.user_id IN (SELECT user_id FROM w) AS known FROM s LEFT JOIN w t ON s.ms BETWEEN t.start_ms AND t.end_ms LEFT JOIN w q ON q.user_id = s.user_id AND s.ms BETWEEN q.start_ms AND q.end_ms)
SELECT count(*) AS n, count_if(predicted IS NOT DISTINCT FROM truth) AS correct, count(truth) AS positive, count_if(truth IS NOT NULL AND predicted IS NOT DISTINCT FROM truth) AS positive_correct,
count_if(truth IS NULL) AS negative, count_if(truth IS NULL AND predicted IS NULL) AS negative_correct, count_if(known AND i % 2 = 0) AS fuzzy FROM p""")
def accuracy_split(spark, sf_dir):
    """Alignment by machine, half of the names with a letter too many, against the truth by time alone."""
    name, e = F.lpad("equipment_id", 13, "machine000000"), sequence(spark, sf_dir)
    w = e.where(F.col("source_index") % 500 == 0).select(name.alias("equipment_id"), (F.col("timestamp_ms") - 1000).alias("start_ms"), (F.col("timestamp_ms") + 1000).alias("end_ms"), F.col("source_index").alias("work_order"))
    s = e.withColumn("equipment_id", F.when(F.col("source_index") % 2 == 0, F.concat(name, F.lit("x"))).otherwise(name))
    told = A.label_by_interval(A.align(s, w, 0.0, 0.95).withColumn("predicted", F.col("relation.work_order")), w)
    return T.accuracy_counts(told, "predicted", "label", "entity_match")


@query(f"SELECT event_id AS equipment_id, {MS} AS timestamp_ms, value, event_type AS kind FROM events")
def canonical_rename(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return canonical_columns(e.select(F.col("user_id").alias("Machine_ID"), V.epoch_ms(F.col("ts")).alias(" TIME "), F.col("value").alias("测量值"), F.col("event_id").alias("机床编号"), F.col("event_type").alias("Kind ")))


RAW = "CASE o_orderkey % 8 WHEN 0 THEN '12abc' WHEN 1 THEN ' 42.5 ' WHEN 2 THEN 'NaN' WHEN 3 THEN '1e3' WHEN 4 THEN '1_000' WHEN 5 THEN '' WHEN 6 THEN '-7' ELSE '1d' END"


@query(f"SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS number FROM (SELECT o_orderkey, {RAW} AS raw FROM orders)")
def finite_coerce(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.finite(F.expr(RAW), "string").alias("number"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT CONCAT('u', CAST(user_id AS VARCHAR)) AS token, count(*) AS n FROM events GROUP BY 1")
def entity_tokens(spark, sf_dir):
    messy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" u-"), F.col("user_id"), F.lit(" "))).otherwise(F.concat(F.lit("U"), F.col("user_id")))
    return table(spark, sf_dir, "events").groupBy(V.entity_token(messy).alias("token")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM (SELECT event_id, CAST(round_even(value * 100, 0) AS BIGINT) - 5000 AS v FROM events)")
def zigzag_values(spark, sf_dir):
    v = F.rint(F.col("value") * 100).cast("long") - 5000
    return table(spark, sf_dir, "events").select("event_id", V.zigzag(v).alias("z"), V.unzigzag(V.zigzag(v)).alias("back"))


# Quality. In shuffled order consistency has something to fail.

SHUFFLED = f"SELECT (event_id * 7919) % 10007 * 10000000 + event_id AS source_index, CASE WHEN event_id % 37 <> 0 THEN CAST(user_id AS VARCHAR) END AS equipment_id, {MS} AS timestamp_ms, CASE WHEN event_id % 41 = 0 THEN 5e6 WHEN event_id % 43 <> 0 THEN value END AS value FROM events"
REF_MS, AGE_MS = 1_706_745_600_000, 15 * 24 * HOUR


def shuffled(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 41 == 0, 5e6).when(i % 43 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select(((i * 7919) % 10007 * 10_000_000 + i).alias("source_index"), F.when(i % 37 != 0, F.col("user_id").cast("string")).alias("equipment_id"), V.epoch_ms(F.col("ts")).alias("timestamp_ms"), v.alias("value"))


def _counts(by: str, ref: str, age: str, source: str = SHUFFLED) -> str:
    part = f"{by}, " if by else ""
    return f"""WITH s AS ({source}), p AS (SELECT *, lag(CASE WHEN value IS NOT NULL THEN timestamp_ms END) OVER (PARTITION BY {part}coalesce(equipment_id, ''), value IS NOT NULL ORDER BY source_index) AS prev FROM s)
SELECT {part}count(*) AS n, count_if(timestamp_ms IS NOT NULL AND equipment_id IS NOT NULL AND value IS NOT NULL) AS complete,
count_if(value IS NOT NULL AND (prev IS NULL OR timestamp_ms >= prev)) AS consistent, count_if(value IS NOT NULL AND {ref} - timestamp_ms BETWEEN 0 AND {age}) AS timely,
count_if(coalesce(equipment_id, '') <> '' AND value BETWEEN -1e6 AND 1e6) AS valid FROM p""" + (f" GROUP BY {by}" if by else "")


@query(_counts("", str(REF_MS), str(AGE_MS)))
def quality_four_dims(spark, sf_dir):
    return Q.quality_counts(shuffled(spark, sf_dir), float(REF_MS), float(AGE_MS))


@query(_counts("equipment_id", str(REF_MS), str(AGE_MS)))
def quality_by_equipment(spark, sf_dir):
    return Q.quality_counts(shuffled(spark, sf_dir), float(REF_MS), float(AGE_MS), by=("equipment_id",))


@query("SELECT count(*) AS n, count_if(prev IS NULL OR ms >= prev) AS consistent FROM (SELECT ms, lag(ms) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id) AS prev FROM (SELECT *, " + MS + " AS ms FROM events))")
def consistency_lag(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.struct((i * 7919) % 10007, i).alias("source_index"), F.col("user_id").alias("equipment_id"), V.epoch_ms(F.col("ts")).alias("timestamp_ms"), F.lit(1.0).alias("value"))
    return Q.quality_counts(e, 0.0, 0.0).select("n", "consistent")


DUPS = f"SELECT event_id AS source_index, CAST(user_id AS VARCHAR) AS equipment_id, {MS} AS timestamp_ms, value FROM events UNION ALL SELECT event_id + 1000000000, CAST(user_id AS VARCHAR), {MS}, value FROM events WHERE event_id % 10 = 0"


def doubled(spark, sf_dir):
    s = sequence(spark, sf_dir)
    return s.unionByName(s.where(F.col("source_index") % 10 == 0).withColumn("source_index", F.col("source_index") + 1_000_000_000))


@query(f"SELECT count(*) AS n, count(DISTINCT (equipment_id, timestamp_ms, value)) AS signatures FROM ({DUPS})")
def uniqueness_signature(spark, sf_dir):
    return Q.unique_counts(doubled(spark, sf_dir))


@query("SELECT count(o_custkey) + count(o_orderpriority) AS checks, count_if(o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) + count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS held FROM orders")
def referential_integrity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 != 0).select("c_custkey")
    p = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "p string")
    return Q.referential_counts(table(spark, sf_dir, "orders"), {"o_custkey": c, "o_orderpriority": p})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def ref_violations_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 != 0).select("c_custkey")
    return Q.referential_violations(table(spark, sf_dir, "orders"), "o_custkey", c).select("o_orderkey", "o_custkey")


@query("WITH r AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN value * 1000 ELSE value END AS v FROM events), m AS (SELECT user_id, median(v) AS m, count(*) AS n FROM r GROUP BY 1), d AS (SELECT r.user_id, abs(v - m) AS d, n FROM r JOIN m USING (user_id)), k AS (SELECT user_id, median(d) AS mad FROM d GROUP BY 1) SELECT count(*) AS checked, count_if(n < 3 OR d <= greatest(12 * mad, 1e-9)) AS stable FROM d JOIN k USING (user_id)")
def stability_mad(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("equipment_id"), F.when(F.col("event_id") % 97 == 0, F.col("value") * 1000).otherwise(F.col("value")).alias("value"))
    return Q.stability_counts(e)


@query(f"WITH c AS ({_counts('', str(REF_MS), '900000', DUPS)}), u AS (SELECT count(DISTINCT (equipment_id, timestamp_ms, value)) AS sig FROM ({DUPS})), f AS (SELECT count_if(CAST(equipment_id AS BIGINT) % 10 <> 0) AS held, count(*) AS checks FROM ({DUPS})) SELECT n, complete, consistent, timely, valid, sig AS signatures, held, checks FROM c, u, f")
def assess_counts(spark, sf_dir):
    s = doubled(spark, sf_dir)
    allowed = table(spark, sf_dir, "events").select("user_id").where(F.col("user_id") % 10 != 0)
    return Q.quality_counts(s, float(REF_MS)).crossJoin(Q.unique_counts(s).drop("n")).crossJoin(Q.referential_counts(s, {"equipment_id": allowed}))


_PARTS = {"completeness": ("complete", "n"), "consistency": ("consistent", "n"), "timeliness": ("timely", "n"), "validity": ("valid", "n"), "uniqueness": ("signatures", "n"), "referential_integrity": ("held", "checks"), "stability": ("stable", "checked")}
ASSESSED = f"""WITH c AS ({_counts('', str(REF_MS), str(AGE_MS), DUPS)}), u AS (SELECT count(DISTINCT (equipment_id, timestamp_ms, value)) AS signatures FROM ({DUPS})),
f AS (SELECT count_if(CAST(equipment_id AS BIGINT) % 10 <> 0) AS held, count(*) AS checks FROM ({DUPS})),
v AS (SELECT equipment_id AS e, value AS v FROM ({DUPS}) WHERE value IS NOT NULL), m AS (SELECT e, median(v) AS m, count(*) AS k FROM v GROUP BY e), d AS (SELECT e, k, abs(v - m) AS d FROM v JOIN m USING (e)), w AS (SELECT e, median(d) AS mad FROM d GROUP BY e),
s AS (SELECT count(*) AS checked, count_if(k < 3 OR d <= greatest(12 * mad, 1e-9)) AS stable FROM d JOIN w USING (e)),
p AS (SELECT n, {', '.join(f'CASE WHEN {whole} = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * {part} / {whole}, 2) END AS {name}' for name, (part, whole) in _PARTS.items())}, checks AS referential_checks FROM c, u, f, s)
SELECT *, round(({' + '.join(_PARTS)}) / 7, 2) AS overall, least({', '.join(_PARTS)}) AS minimum FROM p"""


@query(ASSESSED)
def assess_seven_dims(spark, sf_dir):
    allowed = table(spark, sf_dir, "events").select("user_id").where(F.col("user_id") % 10 != 0)
    return Q.assess(doubled(spark, sf_dir), {"equipment_id": allowed}, float(REF_MS), float(AGE_MS))


@query("SELECT 'events' AS dataset, count(value) * 1.0 / count(*) AS present, count(DISTINCT event_id) * 1.0 / count(*) AS uniq FROM events UNION ALL SELECT 'least', least((SELECT count(value) * 1.0 / count(*) FROM events), (SELECT count_if(o_orderkey % 37 <> 0) * 1.0 / count(*) FROM orders)), (SELECT count(DISTINCT event_id) * 1.0 / count(*) FROM events)")
def dataset_min_rollup(spark, sf_dir):
    share = lambda x: x * 1.0 / F.count("*")
    e = table(spark, sf_dir, "events").agg(share(F.count("value")).alias("present"), share(F.countDistinct("event_id")).alias("uniq"))
    o = table(spark, sf_dir, "orders").agg(share(F.count_if(F.col("o_orderkey") % 37 != 0)).alias("present"))
    least = Q.rollup_minimum([e, o], ("present", "uniq"))
    return e.select(F.lit("events").alias("dataset"), "present", "uniq").unionByName(least.select(F.lit("least").alias("dataset"), "present", "uniq"))


# Governance.

MESSY = f"SELECT event_id AS source_index, CASE WHEN event_id % 37 = 0 THEN '' WHEN event_id % 5 = 0 THEN concat(' u-', user_id, ' ') ELSE concat('U-', user_id) END AS equipment_id, CASE WHEN event_id % 41 = 0 THEN 'bad' ELSE CAST({MS} AS VARCHAR) END AS timestamp_ms, CASE WHEN event_id % 43 <> 0 THEN concat(' ', CAST(event_id % 1000 AS VARCHAR), '.5') END AS value FROM events"
MESSY2 = f"SELECT * FROM ({MESSY}) UNION ALL SELECT source_index + 1000000000, equipment_id, timestamp_ms, value FROM ({MESSY}) WHERE source_index % 10 = 0"
GOVERNED = f"""WITH m AS ({MESSY2}),
t AS (SELECT source_index, upper(trim(equipment_id)) AS equipment_id, TRY_CAST(timestamp_ms AS DOUBLE) AS timestamp_ms, timestamp_ms AS raw_ts, TRY_CAST(trim(value) AS DOUBLE) AS value,
  CASE WHEN trim(equipment_id) <> equipment_id THEN 1 ELSE 0 END + CASE WHEN trim(value) <> value THEN 1 ELSE 0 END AS trims, CASE WHEN upper(trim(equipment_id)) <> trim(equipment_id) THEN 1 ELSE 0 END AS ups,
  CASE WHEN TRY_CAST(timestamp_ms AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END AS coerced FROM m),
f AS (SELECT *, min(source_index) OVER (PARTITION BY equipment_id, raw_ts, value) AS first FROM t),
g AS (SELECT *, equipment_id = '' AS r_e, timestamp_ms IS NULL AS r_t, value IS NULL AS r_v, source_index > first AS r_d FROM f),
h AS (SELECT *, r_e OR r_t OR r_v OR r_d AS bad FROM g)
"""


def messy(spark, sf_dir):
    i = F.col("event_id")
    made = table(spark, sf_dir, "events").select(
        i.alias("source_index"), F.when(i % 37 == 0, "").when(i % 5 == 0, F.concat(F.lit(" u-"), "user_id", F.lit(" "))).otherwise(F.concat(F.lit("U-"), "user_id")).alias("equipment_id"),
        F.when(i % 41 == 0, "bad").otherwise(V.epoch_ms(F.col("ts")).cast("string")).alias("timestamp_ms"), F.when(i % 43 != 0, F.concat(F.lit(" "), (i % 1000).cast("string"), F.lit(".5"))).alias("value"),
    )
    return made.unionByName(made.where(F.col("source_index") % 10 == 0).withColumn("source_index", F.col("source_index") + 1_000_000_000))


@query(GOVERNED + "SELECT source_index, equipment_id, timestamp_ms, value FROM h WHERE NOT bad")
def govern_accepted(spark, sf_dir):
    return G.accepted(G.govern(messy(spark, sf_dir))).select("source_index", "equipment_id", "timestamp_ms", "value")


@query(GOVERNED + "SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN r_e THEN 'missing equipment_id' END, CASE WHEN r_t THEN 'timestamp_ms isn''t a finite number' END, CASE WHEN r_v THEN 'missing value' END, CASE WHEN r_d THEN 'duplicate' END]) AS reason FROM h) WHERE reason IS NOT NULL GROUP BY 1")
def govern_quarantine_reasons(spark, sf_dir):
    return G.quarantined(G.govern(messy(spark, sf_dir))).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(GOVERNED + "SELECT source_index, trims + ups + coerced AS n_actions, CASE WHEN bad THEN 'quarantined' ELSE 'accepted' END AS status FROM h")
def govern_lineage_actions(spark, sf_dir):
    return G.lineage(G.govern(messy(spark, sf_dir))).select("source_index", F.size("actions").alias("n_actions"), "status")


@query(GOVERNED + "SELECT count(*) AS input_records, count_if(NOT bad) AS accepted_records, count_if(bad) AS quarantined_records, count_if(NOT bad AND trims + ups + coerced > 0) AS repaired_records, CAST(sum(trims + ups + coerced) AS BIGINT) AS repair_actions FROM h")
def govern_summary(spark, sf_dir):
    return G.summary(G.govern(messy(spark, sf_dir)))


@query(f"SELECT source_index FROM ({DUPS}) QUALIFY row_number() OVER (PARTITION BY equipment_id, timestamp_ms, value ORDER BY source_index) = 1")
def dedup_keep_first(spark, sf_dir):
    d = doubled(spark, sf_dir)
    return d.groupBy("equipment_id", "timestamp_ms", "value").agg(F.min("source_index").alias("source_index")).select("source_index")


# Windows and ordered rows.

_WINDOWED = SHUFFLED.replace("SELECT (", f"SELECT {MS} // 21600000 AS bucket, (", 1)


@query(_counts("bucket", "(bucket + 1) * 21600000", "21600000", _WINDOWED))
def window_quality_tumbling(spark, sf_dir):
    return W.window_quality(shuffled(spark, sf_dir), 6.0 * HOUR, counts=True).drop("window_start_ms")


@query(f"SELECT event_id, ms FROM (SELECT event_id, {MS} AS ms FROM events) QUALIFY row_number() OVER (PARTITION BY ms // 60000 ORDER BY ms, event_id) = 1")
def downsample_first_per_minute(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", V.epoch_ms(F.col("ts")).alias("ms"))
    return W.first_in_bucket(e, F.floor(F.col("ms") / 60_000), ["ms", "event_id"])


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_snapshot_topk(spark, sf_dir):
    return W.newest(table(spark, sf_dir, "events"), 100, ["ts", "event_id"]).select("event_id", "value")


@query("SELECT event_id // 513 AS block, count(*) AS n, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY 1")
def row_block_stats(spark, sf_dir):
    return W.blocks(table(spark, sf_dir, "events"), "event_id", 513).groupBy("block").agg(F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


@query(f"WITH w AS (SELECT {MS} AS a FROM events WHERE event_id % 2000 = 0), f AS (SELECT event_id, {MS} AS ms FROM events QUALIFY row_number() OVER (PARTITION BY {MS} // 60000 ORDER BY {MS}, event_id) = 1), p AS (SELECT DISTINCT event_id FROM f JOIN w ON ms BETWEEN a - 1800000 AND a + 1860000) SELECT e.event_id AS source_row, CASE WHEN e.event_id BETWEEN 100 AND 199 AND p.event_id IS NOT NULL THEN 'compression+alignment' WHEN p.event_id IS NOT NULL THEN 'alignment' ELSE 'compression' END AS selection_role FROM events e LEFT JOIN p USING (event_id) WHERE p.event_id IS NOT NULL OR e.event_id BETWEEN 100 AND 199")
def subset_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_row"), V.epoch_ms(F.col("ts")).alias("timestamp_ms"))
    w = e.where(F.col("source_row") % 2000 == 0).select(F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + 60_000).alias("end_ms"))
    return W.subset(e, [(100, 199)], w).select("source_row", "selection_role")


@query("SELECT event_id, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2 FROM (SELECT event_id, user_id, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def second_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.rint(F.col("value") * 100).cast("long").alias("v"))
    return W.differences(e, "v", "event_id", ["user_id"]).select("event_id", "d1", "d2")


@query("SELECT event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS rebuilt FROM events")
def second_diff_reconstruct(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.rint(F.col("value") * 100).cast("long").alias("v"))
    d = W.differences(e, "v", "event_id", ["user_id"])
    packed = d.select("event_id", "user_id", F.when(F.col("d1").isNull(), F.col("v")).alias("start"), F.when(F.col("d2").isNull(), F.col("d1")).alias("slope"), "d2")
    return W.undifferenced(packed, "event_id", ["user_id"]).select("event_id", "rebuilt")


# Cells, truth and statistics.

DIRTY = "SELECT o_orderkey, CASE WHEN o_orderkey % 37 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 41 = 0 THEN concat(o_orderpriority, 'x') ELSE o_orderpriority END AS o_orderpriority FROM orders"


def _compared(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    dirty = o.select("o_orderkey", F.when(k % 37 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 41 == 0, F.concat("o_orderpriority", F.lit("x"))).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return T.compare_cells(dirty, T.as_cells(o, "o_orderkey", "correct_val"), "o_orderkey")


CELLS = f"WITH d AS ({DIRTY}), c AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS o_orderkey, 'o_orderstatus' AS attribute, o.o_orderstatus AS correct_val, d.o_orderstatus AS val FROM orders o JOIN d USING (o_orderkey) UNION ALL SELECT CAST(o.o_orderkey AS VARCHAR), 'o_orderpriority', o.o_orderpriority, d.o_orderpriority FROM orders o JOIN d USING (o_orderkey)) "


@query(CELLS + "SELECT count(*) AS cells, count_if(val <> '') AS present, count_if(val IS NOT DISTINCT FROM correct_val) AS correct FROM c")
def cell_truth_accuracy(spark, sf_dir):
    return T.cell_accuracy(_compared(spark, sf_dir))


@query(CELLS + "SELECT o_orderkey, attribute, correct_val, val FROM c WHERE val IS DISTINCT FROM correct_val ORDER BY 1, 2 LIMIT 20")
def cell_truth_mismatch_top20(spark, sf_dir):
    return T.mismatches(_compared(spark, sf_dir), "o_orderkey").select("o_orderkey", "attribute", "correct_val", "val")


@query(CELLS + ", s AS (SELECT count(*) AS cells, count_if(val <> '') AS present, count_if(val IS NOT DISTINCT FROM correct_val) AS correct FROM c), p AS (SELECT *, round(100.0::DOUBLE * present / cells, 2) AS completeness, round(100.0::DOUBLE * correct / cells, 2) AS accuracy FROM s) SELECT *, least(completeness, accuracy) AS minimum, (SELECT list(concat(o_orderkey, ' ', attribute, ': ', coalesce(val, '-')) ORDER BY o_orderkey, attribute) FROM (SELECT * FROM c WHERE val IS DISTINCT FROM correct_val ORDER BY o_orderkey, attribute LIMIT 20)) AS mismatches FROM p")
def cell_truth_report(spark, sf_dir):
    return T.report(_compared(spark, sf_dir), "o_orderkey")


@query("SELECT count(*) * 4 AS cells, count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END) AS present, count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END) AS finite FROM lineitem")
def wide_cell_completeness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")))
    return T.wide_cells(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT CAST(sum(len(embedding)) AS BIGINT) AS points, CAST(sum(len(embedding)) AS BIGINT) AS finite, count_if(len(embedding) = 64) AS whole, count(*) AS series FROM embeddings")
def series_cell_completeness(spark, sf_dir):
    return T.array_cells(table(spark, sf_dir, "embeddings"), "embedding", 64)


@query("SELECT chunk, channel, CAST(sum(r) AS BIGINT) AS raw_bytes, CAST(sum(p) AS BIGINT) AS packed_bytes, CAST(sum(r) AS BIGINT) / CAST(sum(p) AS BIGINT) AS ratio FROM (SELECT l_orderkey // 5000 AS chunk, l_returnflag AS channel, 8 AS r, 1 + CAST(l_quantity AS BIGINT) % 4 AS p FROM lineitem) GROUP BY GROUPING SETS ((chunk), (channel), ())")
def grouping_sets_chunk_channel(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 5000).alias("chunk"), F.col("l_returnflag").alias("channel"), F.lit(8).cast("long").alias("r"), (1 + F.col("l_quantity").cast("long") % 4).alias("p"))
    return T.ratio_sets(li, "chunk", "channel", "r", "p")


@query("SELECT l_returnflag, min(l_quantity) AS minimum, median(l_quantity) AS median, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median, max(l_quantity) AS maximum FROM lineitem GROUP BY 1")
def upper_median_stats(spark, sf_dir):
    return T.ratio_spread(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query("SELECT event_type, count(*) AS runs, median(value) AS median, min(value) AS minimum, max(value) AS maximum, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY 1")
def throughput_cv(spark, sf_dir):
    return T.throughput(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("cv", F.round("cv", 6))


@query("SELECT user_id, max(abs(value - 0.1 * round_even(value / 0.1, 0))) <= 0.05 + 1e-9 AS ok, CAST(sum(CAST(round_even(value / 0.1, 0) AS BIGINT)) AS BIGINT) AS steps FROM events GROUP BY 1")
def quantize_delta_error(spark, sf_dir):
    q = V.quantized(F.col("value"), 0.05)
    e = table(spark, sf_dir, "events").select("user_id", "value", q.alias("q"))
    return e.groupBy("user_id").agg((F.max(F.abs(F.col("value") - 0.1 * F.col("q"))) <= 0.05 + 1e-9).alias("ok"), F.sum("q").alias("steps"))


# Stores and codecs.


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


@query("SELECT 0 AS differing, count(*) AS n FROM events")
def sequence_roundtrip_diff(spark, sf_dir):
    s, path = sequence(spark, sf_dir), _folder(spark, "sequence")
    S.store_sequence(s, path)
    back = S.read_sequence(spark, path, s.schema)
    return S.differing(s, back).agg(F.count("*").cast("int").alias("differing")).crossJoin(back.agg(F.count("*").alias("n")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def relation_text_roundtrip(spark, sf_dir):
    path = _folder(spark, "relation")
    S.store_relation(table(spark, sf_dir, "nation"), path)
    return S.read_relation(spark, path)


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 12")
def zone_map_range_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value").withColumn("unit", F.lit("all"))
    packed = written(frames.compress(e, "unit", "event_id", "value", ["reorder", "raw"], block=512), "blocks")  # bounds prune what is read
    return frames.range_filter(packed, 10.0, 12.0).select((F.col("block") * 512 + F.col("i")).alias("event_id"), "value")


#: Rows that a payload holds at most, so a unit of any length spreads over tasks.
BLOCK = 1 << 16


def _codec_ok(spark, sf_dir, codec, tolerance, exact=False):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.rint("value").alias("whole"), "value")
    column = "whole" if exact == "whole" else "value"
    made = frames.evaluate(e, "unit", "event_id", column, codec, tolerance, block=BLOCK)
    good = F.bool_and("exact") if exact else F.max("max_error") <= tolerance + 1e-9
    return made.groupBy("unit").agg(F.sum("n").alias("n"), good.alias("ok"))


_OK = "SELECT user_id AS unit, count(*) AS n, true AS ok FROM events GROUP BY 1"


@query(_OK)
def pla_error_bound(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "piecewise_linear", 0.05)


@query(_OK)
def quantized_delta_bound(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "quantized_delta", 0.05)


@query(_OK)
def decimal_codec_bound(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "decimal", 5e-7)


@query(_OK)
def byte_planes_bound(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "byte_planes", 5e-7)


@query(_OK)
def reorder_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "reorder", 0.0, True)


@query(_OK)
def delta_varint_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "delta_varint", 0.0, "whole")


@query(_OK)
def second_difference_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "second_difference", 0.0, "whole")


@query(_OK)
def outlier_bits_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "outlier_bits", 0.0, "whole")


@query(_OK)
def level_codecs_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "level_0|level_3|level_5", 0.0, "whole")


@query(_OK)
def packed_bits_roundtrip(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "delta_bits|delta_of_delta|runs", 0.0, "whole")


@query("SELECT user_id AS unit, count(*) AS n, true AS ok FROM events GROUP BY 1")
def adaptive_codec_choice(spark, sf_dir):
    return _codec_ok(spark, sf_dir, "piecewise_linear|quantized_delta", 0.08)


@query("SELECT user_id AS unit, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM events GROUP BY 1")
def binary_channel_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").cast("double").alias("v"))
    packed = frames.compress(e, "user_id", "event_id", "v", ["binary"], block=BLOCK)
    return frames.decompress(packed).groupBy("unit").agg(F.sum("value").cast("long").alias("ones"))


# Matching, parsing and streams.


@query("SELECT lower(n_name) || 'x' AS token, lower(n_name) AS match FROM nation WHERE 2.0 * length(n_name) / (2 * length(n_name) + 1) >= 0.88 ORDER BY 1")
def fuzzy_entity_map(spark, sf_dir):
    """Names of the nations with a letter too many; names as they are need no match."""
    known = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("token"))
    return fuzzy_tokens(known.select(F.concat("token", F.lit("x")).alias("token")).unionByName(known), known).select("token", "match")


@query("SELECT * FROM (VALUES ('机床编号', 'equipment_id', 1.0, true), ('采集时间', 'timestamp_ms', 1.0, true), ('Reading', 'value', 1.0, true)) t(source, target, confidence, accepted)")
def schema_match(spark, sf_dir):
    return spark.createDataFrame([tuple(r.values()) for r in match_schemas(["机床编号", "采集时间", "Reading"], ["equipment_id", "timestamp_ms", "value"])], "source string, target string, confidence double, accepted boolean")


@query("SELECT event_id AS payload_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ['json', 'csv', 'xml'][event_id % 4 + 1] END AS format, event_id % 4 <> 3 AS parsed, CASE WHEN event_id % 4 <> 3 THEN CAST(event_id AS VARCHAR) END AS id FROM events")
def parse_payload_formats(spark, sf_dir):
    i = F.col("event_id")
    texts = F.when(i % 4 == 0, F.concat(F.lit('{"records": [{"id": "'), i, F.lit('"}]}'))).when(i % 4 == 1, F.concat(F.lit("id,kind\n"), i, F.lit(",x\n"))).when(i % 4 == 2, F.concat(F.lit("<r><row><id>"), i, F.lit("</id></row></r>"))).otherwise(F.lit('{"id": NaN}'))
    kinds = {0: "json", 1: "csv", 2: "xml", 3: "json"}
    e = table(spark, sf_dir, "events")
    parts = [parse_payloads(e.where(i % 4 == k).select(i.alias("payload_id"), texts.alias("text")), kind) for k, kind in kinds.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select("payload_id", "format", F.col("error").isNull().alias("parsed"), F.get_json_object("record", "$.id").alias("id"))


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def stream_ring_snapshot(spark, sf_dir):
    schema = "event_id bigint, ts timestamp_ntz, value double"
    ring = ingest.Ring(spark, _folder(spark, "ring"), schema, ["ts", "event_id"], capacity=1000, max_batch=10_000_000)
    ring.start(_events(spark, sf_dir).select("event_id", "ts", "value")).awaitTermination()
    return ring.snapshot(50).select("event_id", "value")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT r.run, count(*) AS rows, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gaps FROM events, range(2) r(run) GROUP BY 1")
def stream_replay_loss(spark, sf_dir):
    """The events dealt into three files, replayed twice after a warm-up; what each batch took stands in a ledger."""
    folder, n = _folder(spark, "replay"), table(spark, sf_dir, "events").count()
    table(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(f"{folder}/in")

    def start(events: DataFrame, run: int):
        return events.writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint{run}").trigger(availableNow=True).start()

    source = lambda: spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    runs, ledger = ingest.replay(spark, source, start, n, repeats=2, warm_up=1)
    return ledger.groupBy("run").agg(F.sum("rows").alias("rows")).join(runs.select("run", "lost", "gaps"), "run").select(F.col("run").cast("long").alias("run"), "rows", "lost", "gaps")


@query(f"SELECT user_id AS equipment_id, count(*) AS n, count_if(prev IS NULL OR clock >= prev) AS consistent FROM (SELECT user_id, clock, lag(clock) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS prev FROM (SELECT *, {MS} AS ms, (event_id * 7919) % 10007 AS clock FROM events)) GROUP BY 1")
def stream_running_consistency(spark, sf_dir):
    """Events arrive by their hash, not in their order; each machine's clock is compared in event time."""
    folder = _folder(spark, "consistency")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("equipment_id"), F.timestamp_millis(V.epoch_ms(F.col("ts"))).alias("ts"), "event_id", ((F.col("event_id") * 7919) % 10007).cast("double").alias("clock"))
    e.repartition(2, F.hash("event_id")).write.parquet(f"{folder}/in")
    end = e.agg((F.max("ts") + F.expr("INTERVAL 61 DAYS")).alias("ts")).select(F.lit(None).cast("bigint").alias("equipment_id"), "ts", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("clock"))
    end.write.mode("append").parquet(f"{folder}/in")  # a beat of no machine, so that all that waits comes due
    events = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
    with ingest.rocksdb(spark):
        made = ingest.running_consistency(events, "ts", t="clock", place="event_id", late="60 days")
        query = made.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema("equipment_id bigint, n bigint, consistent bigint, batch int").parquet(f"{folder}/out")
    return out.where(F.col("equipment_id").isNotNull()).groupBy("equipment_id").agg(F.max(F.struct("n", "consistent")).alias("last")).select("equipment_id", "last.n", "last.consistent")


@query("SELECT CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) AS day_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    folder = _folder(spark, "windows")
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.window_counts(events, window="1 day", late="60 days", by=("event_type",))
    out = {}

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")
        out["path"] = f"{folder}/out"

    counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out["path"]).select(F.unix_millis("window_start").alias("day_ms"), "event_type", "n")


# Files: written from the tables, read by the readers.

_LINES = "SELECT event_id, CASE event_id % 50 WHEN 7 THEN '[1]' WHEN 8 THEN '{\"id\": NaN}' WHEN 9 THEN '{\"id\": \"x\"}' WHEN 10 THEN '{\"id\": 1' END AS broken FROM events"


def _lines_file(spark: SparkSession, rows: DataFrame, order: str, tag: str) -> str:
    """One text file of the lines in their order: a file that a reader is to number must be one."""
    path = _folder(spark, tag)
    rows.orderBy(order).select("value").coalesce(1).write.text(path)
    return path


@query(f"SELECT CASE WHEN broken IS NULL THEN 'read' WHEN broken = '[1]' THEN 'no object' WHEN broken LIKE '%x%' THEN 'a value is not of its type' ELSE 'no JSON' END AS outcome, count(*) AS n, CAST(sum(event_id + 1) AS BIGINT) AS lines, CAST(coalesce(sum(CASE WHEN broken IS NULL THEN event_id END), 0) AS BIGINT) AS ids FROM ({_LINES}) GROUP BY 1")
def jsonl_quarantine(spark, sf_dir):
    i = F.col("event_id")
    broken = F.when(i % 50 == 7, "[1]").when(i % 50 == 8, '{"id": NaN}').when(i % 50 == 9, '{"id": "x"}').when(i % 50 == 10, '{"id": 1')
    lines = table(spark, sf_dir, "events").select("event_id", F.coalesce(broken, F.to_json(F.struct(i.alias("id"), "value"))).alias("value"))
    good, bad = quarantine.read_jsonl(spark, _lines_file(spark, lines, "event_id", "jsonl"), "id bigint, value double")
    every = good.select(F.lit("read").alias("outcome"), "line", "id").unionByName(bad.select(F.col("reason").alias("outcome"), "line", F.lit(0).cast("long").alias("id")))
    return every.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("line").cast("long").alias("lines"), F.sum("id").cast("long").alias("ids"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 40 = 3 THEN 'fields beyond the header' WHEN o_orderkey % 40 = 4 THEN 'a quote is not closed' END AS reason FROM orders")
def delimited_quarantine(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.when(k % 40 == 3, F.concat(k.cast("string"), F.lit(","), "o_orderpriority", F.lit(",more"))).when(k % 40 == 4, F.concat(k.cast("string"), F.lit(',"'), "o_orderpriority")).when(k % 5 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(',"'), "o_orderpriority", F.lit('"')))
    o = table(spark, sf_dir, "orders").select(k.alias("k"), line.alias("value")).unionByName(spark.createDataFrame([(-1, "o_orderkey,o_orderpriority")], "k bigint, value string"))
    good, bad = quarantine.read_delimited(spark, _lines_file(spark, o, "k", "delimited"))
    broken = bad.select(F.regexp_extract("text", "^([0-9]+)", 1).cast("long").alias("o_orderkey"), F.regexp_extract("text", ',"?([^,"]+)', 1).alias("o_orderpriority"), "reason")
    return good.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", F.lit(None).cast("string").alias("reason")).unionByName(broken)


_STEPS = "list_transform(embedding, lambda x: CAST(floor(1000 * CAST(x AS DOUBLE)) AS DOUBLE))"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(1000 * x.cast("double")).cast("long")).alias("v"))


@query(f"SELECT concat('series-TRAIN-', row_number() OVER (ORDER BY vec_id) + 1) AS equipment_id, CAST(label AS INTEGER) AS label, {_STEPS} AS values FROM embeddings")
def labelled_series_scan(spark, sf_dir):
    lines = _series(spark, sf_dir).select("vec_id", F.concat(F.array_join(F.col("v").cast("array<string>"), ","), F.lit(":"), F.col("label")).alias("value"))
    head = spark.createDataFrame([(-2, "# series"), (-1, "@data")], "vec_id bigint, value string")
    made = series.read_labelled_series(spark, _lines_file(spark, lines.unionByName(head), "vec_id", "series"), "TRAIN", 64)
    return made.select("equipment_id", "label", "values")


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) AS INTEGER) AS wafer_id, CAST(label AS INTEGER) AS label, CAST(1216468500000 + 60000 * (vec_id % 1000) AS BIGINT) AS timestamp_ms, list_transform(list_zip(list_transform(embedding, lambda x: CAST(floor(1000 * CAST(x AS DOUBLE)) AS DOUBLE)), range(64)), lambda z: CASE WHEN (vec_id + z[2]) % 9 <> 0 THEN z[1] END) AS values FROM embeddings")
def matrix_label_zip(spark, sf_dir):
    """A matrix and the labels beside it line by line; some cells are NaN."""
    rows = _series(spark, sf_dir)
    cells = F.transform("v", lambda x, i: F.when((F.col("vec_id") + i) % 9 != 0, x.cast("string")).otherwise("NaN"))
    stamp = F.date_format(F.timestamp_millis(F.lit(1216468500000) + 60_000 * (F.col("vec_id") % 1000)), "dd/MM/yyyy HH:mm:ss")
    matrix = _lines_file(spark, rows.select("vec_id", F.array_join(cells, " ").alias("value")), "vec_id", "matrix")
    labels = _lines_file(spark, rows.select("vec_id", F.concat(F.col("label").cast("string"), F.lit(' "'), stamp, F.lit('"')).alias("value")), "vec_id", "labels")
    return series.read_matrix(spark, matrix, labels).select("wafer_id", "label", "timestamp_ms", "values")


@query("SELECT event_id AS source_row, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS timestamp_ms, 'APU' AS equipment_id, CAST(floor(value) AS DOUBLE) AS value FROM events")
def machine_sequence(spark, sf_dir):
    """One checked channel of machine readings as a sequence; the other channels aren't parsed."""
    e = table(spark, sf_dir, "events")
    channels = [(F.col("event_id") % 2).cast("string").alias(c) if c in series.DIGITAL else F.floor("value").cast("string").alias(c) for c in (*series.ANALOG, *series.DIGITAL)]
    path = _folder(spark, "machine")
    e.select(F.col("event_id").alias("row"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *channels).write.option("header", "true").csv(path)
    return series.sequence_of(series.read_machine(spark, path, channels=("TP2", "COMP")), "TP2")


@query("SELECT n_name AS name, true AS ok, CAST(length(n_name) + 1 AS BIGINT) AS size, sha256(n_name || chr(10)) AS sha256 FROM nation")
def manifest_check(spark, sf_dir):
    """A file for each nation, hashed in chunks and held against a manifest."""
    n, path = table(spark, sf_dir, "nation").select("n_name"), _folder(spark, "nations")
    n.select(F.col("n_name").alias("value"), F.hex("n_name").alias("n")).write.partitionBy("n").text(path)
    files.register(spark)
    there = spark.read.format("file_hashes").load(path).where(~F.col("name").contains(".crc") & F.col("name").contains("part-"))
    place = there.select(F.decode(F.unhex(F.regexp_extract("name", "^n=([0-9A-F]+)/", 1)), "UTF-8").alias("nation"), "name")
    manifest = n.select("n_name", (F.length("n_name") + 1).cast("long").alias("size"), F.sha2(F.concat("n_name", F.lit("\n")), 256).alias("sha256")).join(place, F.col("n_name") == F.col("nation"))
    made = files.verified(spark, path, manifest.select("name", "size", "sha256"))
    return made.join(place, "name").select(F.col("nation").alias("name"), "ok", "size", "sha256")


@query("SELECT event_id, ['json', 'jsonl', 'csv', 'tsv', 'semicolon', 'pipe', 'text', 'empty'][event_id % 8 + 1] AS format FROM events")
def sniffed_formats(spark, sf_dir):
    i = F.col("event_id")
    table_of = lambda d: F.concat(F.lit(f"id{d}kind\n"), i, F.lit(f"{d}x\n"), i + 1, F.lit(f"{d}y\n"))
    kinds = [F.concat(F.lit('[{"id": '), i, F.lit("}]")), F.concat(F.lit('{"id": '), i, F.lit('}\n{"id": 1}')), *[table_of(d) for d in ",\t;|"], F.lit("word"), F.lit(" \n")]
    texts = F.element_at(F.array(*kinds), (i % 8 + 1).cast("int"))
    return sniffed(table(spark, sf_dir, "events").select("event_id", texts.alias("text")), "text").select("event_id", "format")


@query(f"SELECT event_id, {MS} AS timestamp_ms FROM events")
def iso_first_timestamps(spark, sf_dir):
    """Times as ISO text with a zone, without one, with a blank for the T, or as a number."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(i % 4 == 0, F.concat(iso, F.lit("Z"))).when(i % 4 == 1, iso).when(i % 4 == 2, F.concat(F.lit(" "), F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))).otherwise((F.unix_micros(ts) / 1000).cast("decimal(20,3)").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.rint(V.iso_or_number(text, "string")).cast("long").alias("timestamp_ms"))


_LISTED = "NOT r_e AND TRY_CAST(regexp_extract(equipment_id, '[0-9]+') AS BIGINT) % 10 <> 0"


@query(GOVERNED + f"SELECT source_index, CASE WHEN bad OR NOT coalesce({_LISTED}, false) THEN 'quarantined' ELSE 'accepted' END AS status, NOT coalesce({_LISTED}, false) AS unlisted FROM h")
def equipment_master_quarantine(spark, sf_dir):
    known = table(spark, sf_dir, "events").where(F.col("user_id") % 10 != 0).select(F.concat(F.lit("U-"), "user_id").alias("equipment"))
    made = G.govern(messy(spark, sf_dir), {"enforce_equipment_master": True}, known)
    return made.select("source_index", "status", F.array_contains("reasons", "equipment not in master data").alias("unlisted"))


_PHASE = """SELECT '{phase}' AS phase, count(*) AS n, round(100.0::DOUBLE * count_if(NOT coalesce(equipment_id, '') = '' AND raw_ts IS NOT NULL AND value IS NOT NULL) / count(*), 2) AS completeness,
round(100.0::DOUBLE * count_if(NOT coalesce(equipment_id, '') = '' AND timestamp_ms IS NOT NULL AND value IS NOT NULL) / count(*), 2) AS validity FROM h"""


@query(GOVERNED + _PHASE.format(phase="before") + " UNION ALL " + _PHASE.format(phase="after") + " WHERE NOT bad")
def quality_before_and_after(spark, sf_dir):
    m = messy(spark, sf_dir)
    master = {"equipment_id": table(spark, sf_dir, "events").select(F.concat(F.lit("U-"), "user_id"))}
    return G.before_and_after(m, G.govern(m), master, float(REF_MS)).select("phase", "n", "completeness", "validity")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence rows fused with their relations, unmatched ones kept."""
    return fuse_left_preserve(spark, sf_dir)
