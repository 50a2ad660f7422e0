"""Reads that keep going, and files beyond a row: rejected lines, zipped rows, hashes in chunks."""

from __future__ import annotations

import hashlib
import zipfile

import pytest

from strandline.operators import truth
from strandline.sources import files, quarantine


def test_a_broken_line_loses_itself_only(spark, tmp_path):
    lines = ['\ufeff{"id":1,"v":2.5}', "", '{"id":"x"}', "[1]", '{"id":2', '{"id":NaN}', '{"id":3,"more":[1]}\r', "nonsense", '{"id":4,"id":5}', "{}"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    good, bad = quarantine.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, v double")
    assert sorted((r.line, r.id, r.v) for r in good.collect()) == [(1, 1, 2.5), (7, 3, None), (9, 5, None), (10, None, None)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(3, "a value is not of its type"), (4, "no object"), (5, "no JSON"), (6, "no JSON"), (8, "no JSON")]


def test_delimited_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x ""y"", z"\n2\n3,a,b\n4,"open\n\n5,last\n', encoding="utf-8")
    good, bad = quarantine.read_delimited(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [(2, "1", 'x "y", z'), (3, "2", None), (7, "5", "last")]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(4, "fields beyond the header"), (5, "a quote is not closed")]
    (tmp_path / "b.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError):
        quarantine.read_delimited(spark, str(tmp_path / "b.csv"))


def test_dirty_and_truth(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x,y\na,b\nc,d,e\nq,\n")
    (tmp_path / "t.csv").write_text("tid,attribute,correct_val\n1,x,a\n1,y,B\n3,x,q\n3,y,z\n2,x,c\n")
    dirty, right, bad = quarantine.read_dirty_and_truth(spark, str(tmp_path / "d.csv"), str(tmp_path / "t.csv"))
    row = truth.cell_accuracy(truth.compare_cells(dirty, right, "tid")).first()
    assert (row.cells, row.present, row.correct) == (5, 3, 2) and [(r.file, r.line) for r in bad.collect()] == [("dirty", 3)]


def test_zipped_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "\ufeffn,t,`odd`\n" + "".join(f"{k},t{k},o\n" for k in range(100_000)))
        z.writestr("b.csv", 't,n,`odd`\n"x\ny",7,z\n')
    files.register(spark)
    read = lambda **o: spark.read.format("zipped_rows").options(**o).load(str(tmp_path / "z.zip"))
    got = read(columns="n,t", expected="a.csv=100000,b.csv=1")
    assert got.columns == ["member", "source_row", "n", "t"] and got.rdd.getNumPartitions() == 2
    assert got.where("member = 'b.csv'").first()[1:] == (0, "7", "x\ny")
    assert got.where("member = 'a.csv' AND n = source_row AND t = 't' || n").count() == 100_000
    assert read().columns == ["member", "source_row", "n", "t", "`odd`"]
    for wrong in ({"expected": "a.csv=99,b.csv=1"}, {"columns": "n,none"}, {"expected": "5"}):
        with pytest.raises(Exception, match="rows|lacks"):
            read(**wrong).collect()


def test_hashes_in_chunks(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    big = tmp_path / "d" / "big.bin"
    with big.open("wb") as f:  # 3 GB that take no room: more than one row can hold
        f.truncate(3 << 30)
    (tmp_path / "d" / "s").mkdir()
    (tmp_path / "d" / "s" / "a.bin").write_bytes(b"abc")
    sums = hashlib.sha256()
    for _ in range(3 << 7):
        sums.update(bytes(1 << 23))
    rows = [("big.bin", 3 << 30, sums.hexdigest()), ("s/a.bin", 3, hashlib.sha256(b"abc").hexdigest().upper()), ("s/../s/a.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("none", 1, "0")]
    made = files.verified(spark, str(tmp_path / "d"), spark.createDataFrame(rows, "name string, size long, sha256 string"))
    assert {r.name: r.ok for r in made.collect()} == {"big.bin": True, "s/a.bin": True, "s/../s/a.bin": False, "none": False}
