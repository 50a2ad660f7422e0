"""Repair, quarantine and lineage of records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.schema import canonical_columns
from strandline.functions.values import finite, iso_or_number
from strandline.operators.quality import assess
from strandline.session import written

#: The order in which rows repair: fields by name, then equipment, then numbers.
NUMBERS = ("timestamp_ms", "value")


@dataclass(frozen=True)
class Rules:
    trim_strings: bool = True
    normalize_equipment_id: bool = True
    coerce_numeric_fields: bool = True
    remove_duplicates: bool = True
    enforce_equipment_master: bool = False

    @classmethod
    def of(cls, given: dict | None) -> Rules:
        """Defaults with what is given; unknown names and other values than booleans are errors."""
        given = given or {}
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(unknown)}")
        for name, value in given.items():
            if not isinstance(value, bool):
                raise ValueError(f"rule {name} must be a boolean")
        return cls(**(asdict(cls()) | given))


def repair(records: DataFrame, rules: Rules | dict | None = None, order: str = "source_index") -> DataFrame:
    """records under canonical names, repaired, with `actions` (rule, field) and the `reasons` that values themselves give.

    timestamp_ms and value become doubles, null where they aren't numbers; a reason names the field then. ISO times without a zone are UTC.
    """
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    df = canonical_columns(records)
    kinds, actions, reasons = dict(df.dtypes), [], []
    act = lambda when, rule, field: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field")))
    columns = {c: F.col(c) for c in df.columns}
    for c in [c for c in df.columns if kinds[c] == "string" and c != order]:
        if rules.trim_strings:
            cut = F.btrim(columns[c], F.lit(" \t\n\r\x0b\x0c"))
            actions.append(act(cut != columns[c], "trim_strings", c))
            columns[c] = cut
    if rules.normalize_equipment_id and "equipment_id" in columns:
        made = F.upper(F.btrim(columns["equipment_id"].cast("string"), F.lit(" \t\n\r\x0b\x0c")))
        actions.append(act(made != columns["equipment_id"].cast("string"), "normalize_equipment_id", "equipment_id"))
        columns["equipment_id"] = made
    raw, reads = {}, {}
    for c in NUMBERS:
        if c not in columns:
            columns[c] = F.lit(None).cast("double")
            reasons.append(F.lit(f"missing {c}"))
            continue
        text = kinds[c] == "string"
        empty = columns[c].isNull() | (columns[c] == "") if text else columns[c].isNull()
        reasons.append(F.when(empty, F.lit(f"missing {c}")))
        reads[f"_{c}_read"] = iso_or_number(columns[c], kinds[c]) if c == "timestamp_ms" else finite(columns[c], kinds[c])
        number = F.col(f"_{c}_read")  # read once in a step of its own, however often it is asked for below
        if rules.coerce_numeric_fields:
            reasons.append(F.when(~empty & number.isNull(), F.lit(f"{c} isn't a finite number")))
            if text:
                actions.append(act(~empty & number.isNotNull(), "coerce_numeric_fields", c))
        raw[c] = F.coalesce(number.cast("string"), columns[c].cast("string"))
        columns[c] = number
    entity = columns.get("equipment_id", F.lit(None).cast("string"))
    reasons.append(F.when(entity.isNull() | (entity == ""), F.lit("missing equipment_id")))
    listed = F.array_compact(F.array(*actions)) if actions else F.array().cast("array<struct<rule:string,field:string>>")
    signature = [entity.alias("_s1"), raw.get("timestamp_ms", F.lit(None)).alias("_s2"), raw.get("value", F.lit(None)).alias("_s3")]
    return df.select("*", *[x.alias(c) for c, x in reads.items()]).select(*[x.alias(c) for c, x in columns.items()], listed.alias("actions"), F.array_compact(F.array(*reasons)).alias("reasons"), *signature)


def govern(records: DataFrame, rules: Rules | dict | None = None, equipment: DataFrame | None = None, order: str = "source_index") -> DataFrame:
    """Each record, repaired, with actions, status (accepted or quarantined) and its sorted, distinct reasons.

    A record repeats an earlier one, in `order`, with equal equipment, time and value after repair, be that accepted or not. The
    first of each signature is found by a map-side aggregate and joined back, so one signature of many rows is no single task's.
    equipment: the master list, one column, for enforce_equipment_master.
    """
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    df = repair(records, rules, order)
    extra = []
    if rules.remove_duplicates:
        keys = ["_s1", "_s2", "_s3"]
        first = df.groupBy(*keys).agg(F.min(order).alias("_first"), *[F.first(F.lit(1)).alias("_one")]).drop("_one").withColumnsRenamed({k: k + "b" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & df[k].eqNullSafe(first[k + "b"])
        df = df.join(first, same).drop(*[k + "b" for k in keys])
        extra.append(F.when(F.col(order) > F.col("_first"), F.lit("duplicate")))
    if rules.enforce_equipment_master:
        if equipment is None:
            raise ValueError("enforce_equipment_master needs the list of equipment")
        dim = equipment.select(F.col(equipment.columns[0]).cast("string").alias("_m")).distinct()
        df = df.join(dim, F.coalesce(F.col("equipment_id"), F.lit("")) == F.col("_m"), "left")
        extra.append(F.when(F.col("_m").isNull(), F.lit("equipment not in master data")))
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", F.array_compact(F.array(*extra))) if extra else F.col("reasons")))
    df = df.withColumn("reasons", reasons).drop("_s1", "_s2", "_s3", "_first", "_m")
    return df.withColumn("status", F.when(F.size("reasons") > 0, "quarantined").otherwise("accepted"))


def accepted(governed: DataFrame) -> DataFrame:
    return governed.where(F.col("status") == "accepted").drop("status", "reasons", "actions")


def quarantined(governed: DataFrame) -> DataFrame:
    return governed.where(F.col("status") == "quarantined").drop("status", "actions")


def lineage(governed: DataFrame, order: str = "source_index") -> DataFrame:
    return governed.select(order, "actions", "status", "reasons")


def summary(governed: DataFrame) -> DataFrame:
    ok = F.col("status") == "accepted"
    return governed.agg(
        F.count("*").alias("input_records"), F.count_if(ok).alias("accepted_records"), F.count_if(~ok).alias("quarantined_records"),
        F.count_if(ok & (F.size("actions") > 0)).alias("repaired_records"), F.coalesce(F.sum(F.size("actions")), F.lit(0)).alias("repair_actions"),
    )


def before_and_after(records: DataFrame, governed: DataFrame, master: dict[str, DataFrame], reference_ms: float, order: str = "source_index") -> DataFrame:
    """The seven dimensions of the records as they came and of those accepted. Both are written once, as each dimension reads them."""
    a = assess(written(canonical_columns(records), "records"), master, reference_ms, order=order).withColumn("phase", F.lit("before"))
    return a.unionByName(assess(written(accepted(governed), "accepted"), master, reference_ms, order=order).withColumn("phase", F.lit("after")))
