"""A payload from text to report: parse, canonicalize, assess, govern, assess again."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from strandline.functions.schema import canonical_columns
from strandline.operators import govern as G
from strandline.operators.align import fuse
from strandline.operators.quality import assess
from strandline.sources.text import Adapters

#: Characters of a payload that is parsed on the driver; larger inputs are read from files by strandline.sources.
MAX_PAYLOAD = 12 * 1024 * 1024


def records_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records as text columns, by name, with their place as source_index; what is nested becomes JSON, what is missing null."""
    names = sorted({k for r in rows for k in r})
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    data = [(i, *[text(r.get(n)) for n in names]) for i, r in enumerate(rows)]
    schema = "source_index long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return spark.createDataFrame(data, schema)


def parse(spark: SparkSession, payload: str, kind: str = "auto", adapters: Adapters | None = None) -> tuple[str, DataFrame]:
    if len(payload) > MAX_PAYLOAD:
        raise ValueError("the payload is too large; read it from files")
    found, rows = (adapters or Adapters()).parse(payload, kind)
    return found, canonical_columns(records_frame(spark, rows))


def analyze(spark: SparkSession, payload: str, master: dict[str, DataFrame], reference_ms: float, kind: str = "auto", rules: dict | None = None) -> dict:
    """Format, rules, summary and quality before and after of a payload; the reference time is explicit, so that results repeat."""
    found, records = parse(spark, payload, kind)
    checked = G.Rules.of(rules)
    equipment = master.get("equipment_id")
    governed = G.govern(records, checked, equipment).persist()
    try:
        before = assess(records, master, reference_ms).first().asDict()
        after = assess(G.accepted(governed), master, reference_ms).first().asDict()
        return {
            "format": found, "columns": sorted(c for c in records.columns if c != "source_index"), "rules": asdict(checked), "summary": G.summary(governed).first().asDict(),
            "quality_before": before, "quality_after": after, "preview": [r.asDict() for r in G.accepted(governed).orderBy("source_index").limit(8).collect()],
        }
    finally:
        governed.unpersist()


def fuse_payloads(spark: SparkSession, sequence: str, relations: str, tolerance_ms: float = 1000.0) -> DataFrame:
    """Two payloads fused: every sequence record once, in its place, with the relation it falls in."""
    _, left = parse(spark, sequence)
    _, right = parse(spark, relations)
    return fuse(left, right, tolerance_ms, relation_order="source_index")
