"""Readers and parsers: what they take and what they refuse."""

from __future__ import annotations

import hashlib

import pytest

from strandline.sources import files, series, text


def test_sniffing():
    cases = {"": "empty", " \n": "empty", "[1]": "json", '{"a":1}': "json", '{"a":1}\n{"a":2}': "jsonl", '{\n"a": 1}': "json", "a,b\n1,2\n": "csv", "a\tb\n1\t2\n": "tsv", "a;b\n1;2\n": "semicolon", "a|b\n1|2\n": "pipe"}
    assert {k: text.detect_format(k) for k in cases} == cases


def test_json():
    assert text.parse_json('{"records":[{"id":1}],"data":[2]}') == [{"id": 1}]
    assert text.parse_json('{"records":[{"id":1}],"records":[{"id":2}]}') == [{"id": 2}]
    assert text.parse_json('{"data":[{"id":3}],"records":null}') == [{"id": 3}]
    assert text.parse_json('{"id":4}') == [{"id": 4}]
    assert text.parse_jsonl('{"a":1}\n\n{"a":2}\n') == [{"a": 1}, {"a": 2}]
    for bad in ('{"records":[{"id":1},2]}', "[NaN]", '{"a":Infinity}', "{}x", "[" * 5000 + "]" * 5000, "[1"):
        with pytest.raises((ValueError, RecursionError)):
            text.parse_json(bad)
    with pytest.raises(ValueError, match="line 2"):
        text.parse_jsonl("{}\n[]")


def test_delimited():
    assert text.parse_delimited("a,b\n1,2\n3\n", ",") == [{"a": "1", "b": "2"}, {"a": "3", "b": None}]
    for bad in ("a,a\n1,2", "a,A\n1,2", "a,\n1,2", "a,b\n1,2,3", "", ",".join(f"c{i}" for i in range(3000)) + "\n"):
        with pytest.raises(ValueError):
            text.parse_delimited(bad, ",")


def test_xml_and_ini():
    assert text.parse_xml("<r><row><a>1</a><b/></row><leaf>2</leaf></r>") == [{"a": "1", "b": ""}, {"tag": "leaf", "value": "2"}]
    assert text.parse_xml("<r>x</r>") == [{"r": "x"}]
    for bad in ('<!DOCTYPE r [<!ENTITY x "y">]><r>&x;</r>', "<r>"):
        with pytest.raises(ValueError):
            text.parse_xml(bad)
    assert text.parse_ini("[DEFAULT]\nx=1\n[a]\ny=2\n") == [{"section": "a", "y": "2", "x": "1"}]


def test_adapters():
    a = text.Adapters()
    assert a.parse("﻿a,b\n1,2\n") == ("csv", [{"a": "1", "b": "2"}]) and len(a.known) == 8
    a.register("Mine", lambda t: [{"x": t}])
    assert a.parse("q", "mine")[1] == [{"x": "q"}]
    a.register("bad", lambda t: [{"": 1}])
    for kind, payload in (("bad", "x"), ("other", "x"), ("csv", "a,b\n"), ("auto", "a﻿,b\n1,2"), ("json", "[]")):
        with pytest.raises(ValueError):
            a.parse(payload, kind)


def test_payloads(spark):
    df = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, "{bad"), (3, None), (4, "a,b\n1,2\n")], "payload_id int, text string")
    got = text.parse_payloads(df).collect()
    assert sorted((r.payload_id, r.format, r.row, r.record) for r in got if r.error is None) == [(1, "json", 0, '{"a": 1}'), (1, "json", 1, '{"a": 2}'), (4, "csv", 0, '{"a": "1", "b": "2"}')]
    assert {r.payload_id for r in got if r.error} == {2, 3}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x ""y"""\n2\n', encoding="utf-8")
    assert sorted(tuple(r) for r in text.read_delimited(spark, str(tmp_path / "a.csv")).collect()) == [("1", 'x "y"'), ("2", None)]
    (tmp_path / "b.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="beyond"):
        text.read_delimited(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.json").write_text('{"meta":1,"rows":[{"id":7}],"data":null}')
    (tmp_path / "d.json").write_text('[{"id":8},{"id":9}]')
    (tmp_path / "e.json").write_text('{"id":10}')
    got = [r.id for f in "cde" for r in text.read_wrapped_json(spark, str(tmp_path / f"{f}.json"), "id int").collect()]
    assert got == [7, 8, 9, 10]
    (tmp_path / "f.jsonl").write_text('{"id":1}\n\n{"id":2}\n')
    assert text.read_jsonl(spark, str(tmp_path / "f.jsonl"), "id int").count() == 2
    (tmp_path / "g.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert sorted(r.a for r in text.read_xml(spark, str(tmp_path / "g.xml"), "row", "a int").collect()) == [1, 2]


def test_series(spark, tmp_path):
    (tmp_path / "x.ts").write_text("# comment\n@problem x\n@data\n1,2,3:1\n# no\n4,5,6:-1\n")
    got = series.read_labelled_series(spark, str(tmp_path / "x.ts"), "TRAIN", 3).orderBy("source_row").collect()
    assert [(r.label, r["values"]) for r in got] == [(1, [1.0, 2.0, 3.0]), (-1, [4.0, 5.0, 6.0])]
    for broken in ("1,2:1", "1,x,3:1", "1,2,3", "1,nan,3:1"):
        (tmp_path / "y.ts").write_text(f"@data\n{broken}\n")
        with pytest.raises(Exception, match="broken line"):
            series.read_labelled_series(spark, str(tmp_path / "y.ts"), "TRAIN", 3).collect()


def test_matrix(spark, tmp_path):
    (tmp_path / "m").write_text("1.5 NaN 3\n4 5 6\n")
    (tmp_path / "l").write_text('-1 "19/07/2008 11:55:00"\n1 "19/07/2008 12:32:00"\n')
    got = series.read_matrix(spark, str(tmp_path / "m"), str(tmp_path / "l")).orderBy("wafer_id").collect()
    assert got[0]["values"] == [1.5, None, 3.0] and got[0].label == -1 and got[0].timestamp_ms == 1216468500000
    (tmp_path / "l").write_text('-1 "19/07/2008 11:55:00"\n')
    with pytest.raises(Exception, match="length"):
        series.read_matrix(spark, str(tmp_path / "m"), str(tmp_path / "l")).collect()


def test_machine(spark, tmp_path):
    head = ",timestamp," + ",".join((*series.ANALOG, *series.DIGITAL))
    row = lambda i, d: f"{i},2020-02-01 00:00:0{i}," + ",".join(["1.5"] * 7 + [str(d)] + ["0.0"] * 7)
    (tmp_path / "m.csv").write_text("\n".join([head, row(0, 1.0), row(1, 0.0)]) + "\n")
    seq = series.sequence_of(series.read_machine(spark, str(tmp_path / "m.csv"), channels=("TP2", "COMP")), "TP2").orderBy("source_row").collect()
    assert [(r.timestamp_ms, r.value) for r in seq] == [(1580515200000, 1.5), (1580515201000, 1.5)]
    (tmp_path / "n.csv").write_text("\n".join([head, row(0, 2.0)]) + "\n")
    with pytest.raises(Exception, match="COMP"):
        series.read_machine(spark, str(tmp_path / "n.csv")).collect()
    (tmp_path / "f.csv").write_text("failure_id,equipment_id,start_time,end_time,failure,severity\nF1,APU,2020-04-18 00:00:00,2020-04-18 23:59:00,leak,high\n")
    assert series.read_failures(spark, str(tmp_path / "f.csv")).first().end_ms == 1587254340000
    (tmp_path / "b.tsv").write_text("0.1\t0.2\t0.3\t0.4\n1\t2\t3\t4\n")
    got = series.read_bearings(spark, str(tmp_path / "b.tsv")).orderBy("sample_index").collect()
    assert [r.timestamp_ns for r in got] == [0, 50_000] and got[1].bearing_4 == 4.0


def test_verified(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    sums = hashlib.sha256(b"abc").hexdigest()
    m = spark.createDataFrame([("a.bin", 3, sums), ("a.bin", 4, sums), ("../a.bin", 3, sums), ("b.bin", 3, sums)], "name string, size long, sha256 string")
    assert [r.ok for r in files.verified(spark, str(tmp_path), m).orderBy("ok").collect()] == [False, False, False, True]
