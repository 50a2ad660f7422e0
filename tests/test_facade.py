"""Payloads from text to report."""

from __future__ import annotations

import pytest

from strandline.plans import facade


def test_analyze(spark):
    master = {"equipment_id": spark.createDataFrame([("CNC-01",)], "v string")}
    payload = "time,machine_id,reading\nnot-a-time,CNC-01,42.1\n1767225600001,CNC-01,42.2\n"
    made = facade.analyze(spark, payload, master, 1767225600001.0)
    assert made["format"] == "csv" and made["columns"] == ["equipment_id", "timestamp_ms", "value"]
    assert made["quality_before"]["validity"] < 100 and made["quality_after"]["validity"] == 100
    assert made["summary"]["quarantined_records"] == 1 and made["preview"][0]["value"] == 42.2
    with pytest.raises(ValueError):
        facade.analyze(spark, payload, master, 0.0, rules={"nothing": True})
    with pytest.raises(ValueError):
        facade.parse(spark, "x" * (facade.MAX_PAYLOAD + 1))


def test_fuse_payloads(spark):
    seq = '[{"equipment_id":"CNC-01","timestamp_ms":1000,"value":42.0},{"equipment_id":"CNC-01","timestamp_ms":9e9,"value":1}]'
    rel = '[{"device_id":"CNC-01","start_time":0,"end_time":2000,"work_order":"BROAD"},{"device_id":"CNC-01","start_time":990,"end_time":1010,"work_order":"PRECISE","tags":["a"]}]'
    got = facade.fuse_payloads(spark, seq, rel, 0.0).orderBy("source_index").collect()
    assert [r.relation_work_order for r in got] == ["PRECISE", None] and got[0].relation_tags == '["a"]'
