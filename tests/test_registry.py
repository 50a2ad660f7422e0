"""Registry gates, reports and retention."""

from __future__ import annotations

import json
import os

import pytest

from strandline.plans import registry as R


def test_registry():
    made = R.default_registry()
    assert all(h["ok"] for h in made.health().values()) and {"alignment", "quality", "compression"} <= set(made.matrix())
    for spec in (R.Spec("x", "os:system"), R.Spec("x", "strandline.codecs.bits:pack; y"), R.Spec("X Y", "strandline.codecs.bits:pack"), R.Spec("y", "strandline.codecs.bits:pack", source="https://example.org")):
        with pytest.raises(ValueError):
            made.register(spec)
    with pytest.raises(ValueError):
        made.register(R.Spec("align", "strandline.codecs.bits:pack"))
    made.register(R.Spec("failing", "strandline.codecs.bits:pack"), lambda: 1 / 0)
    assert not made.health()["failing"]["ok"]
    with pytest.raises(ValueError):
        made.resolve("nothing")


def test_manifest_is_whole_or_none():
    made = R.Registry()
    good = {"id": "pack", "entry": "strandline.codecs.bits:pack", "serves": ["compression"]}
    with pytest.raises(ValueError):
        made.load(json.dumps({"algorithms": [good, {"id": "bad", "entry": "os:system"}]}))
    assert not made.specs and made.load(json.dumps({"algorithms": [good]})) == ["pack"]


def test_reports(tmp_path):
    for i in range(5):
        p = R.write_report({"i": i}, str(tmp_path), f"r{i}")
        os.utime(p, (i, i))
    (tmp_path / "open.json").write_text("{}")
    assert sorted(R.prune(str(tmp_path), 2, active=frozenset({"r0"}))) == ["r1", "r2"]
    assert sorted(p.stem for p in tmp_path.glob("*.json")) == ["open", "r0", "r3", "r4"]
    assert R.prune(str(tmp_path), 0, grace_s=10.0**12) == []
