"""The cheap gates of licence rules drop no text that the rules match."""

from __future__ import annotations

import re
from dataclasses import replace

from strandline.llm import licenses

from . import brute

NAMES = ["MIT", "Expat", "Apache 2.0", "Apache License v2", "GPL 3.0", "GPL v3", "GNU General Public License v3", "GPL v2", "GNU General Public License, version 2", "LGPL v2.1", "LGPL-3.0", "GNU Lesser General Public License v3", "AGPL-3.0",
         "Affero General Public License v3", "BSD 2-Clause", "ISC", "Mozilla Public License 2.0", "zlib/libpng", "PostgreSQL", "Ruby", "PHP 3.01", "OpenSSL", "Python Software Foundation", "CC0 1.0", "CC BY-SA 4.0", "the public domain", "WTFPL", "EUPL 1.2"]
FORMS = ["SPDX-License-Identifier: {}", "Released under {}", "DISTRIBUTED under the terms of the {}", "available under {}", "offered  under-the {}", "redistributed under {}", "released into {}", "dedicated to {}", "committed in {}", "under the {} licence", "{} license", "license is {}", "{}"]


def test_gates_change_nothing(spark, monkeypatch):
    """Every text ends with the word by which the ungated rules are tried on all."""
    texts = [form.format(name) + " zzz" for form in FORMS for name in NAMES] + ["nothing of it zzz"]
    docs = brute.frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    read = lambda: {texts[r.doc_id]: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    gated, every = read(), licenses.rules()
    monkeypatch.setattr(licenses, "rules", lambda: [replace(r, gate="zzz") for r in every])
    monkeypatch.setattr(licenses, "PREFILTER", "")
    assert gated == read()
    for text, label in (("Released under GPL 3.0", "gpl-3"), ("available under MIT", "mit"), ("Released under GNU General Public License v3", "gpl-3"), ("GPL v2 license", "gpl-2"), ("LGPL v2.1 license", "lgpl-2.1"), ("Expat license", "mit")):
        assert label in gated[text + " zzz"][0].split(","), text


def example(tree):
    """A text that a pattern matches: first branches, least repeats."""
    out = ""
    for op, what in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(what)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            kind, first = what[0]
            out += "x" if str(kind) == "NEGATE" else "1" if str(kind) == "CATEGORY" else chr(first if isinstance(first, int) else first[0])
        elif name == "SUBPATTERN":
            out += example(what[3])
        elif name == "BRANCH":
            out += example(what[1][0])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(what[2]) * what[0]
        elif name not in ("ASSERT", "ASSERT_NOT"):
            raise ValueError(name)
    return out


def test_every_rule_finds_its_example(spark):
    """A text made from the pattern of each rule passes prefilter and gate and gets the rule's label, unless a rule that outranks it covers it."""
    every = licenses.rules()
    texts = ["See: " + example(re._parser.parse(r.pattern[6:-5])) + "." for r in every]
    got = {r.doc_id: r for r in licenses.scan(brute.frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    lost = [(r.label, t, got[i].labels) for i, (r, t) in enumerate(zip(every, texts, strict=True)) if r.label not in got[i].labels.split(",")]
    covered = [x for x in lost if x[2]]
    assert not [x for x in lost if not x[2]] and len(covered) < 25, lost
    assert len(every) > 400


def test_plain_notices(spark):
    told = {
        "Released under GPL v3.": "gpl-3", "licensed under the GPL v3 license": "gpl-3", "GPLv3": "gpl-3", "License: LGPL v2.1": "lgpl-2.1", "Distributed under the terms of the EUPL": "eupl-1.2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "Redistribution and use in source and binary forms": "bsd", "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "The origin of this software must not be misrepresented": "zlib", "under the same terms as Perl itself": "perl",
    }
    got = licenses.scan(brute.frame(spark, [(i, t, "en", "s") for i, t in enumerate(told)])).collect()
    assert {r.doc_id: r.labels for r in got} == dict(enumerate(told.values()))
    assert all(r.score > 0 for r in got)


def test_labels_against_brute_force(spark):
    """Labels and score by all rules over all places, containment by comparing all detections."""
    every = licenses.rules()
    texts = [f"{a}, {b}; {c}" for a in ("Released under GPL v3", "plain words", "MIT license") for b in ("under the Apache License, Version 2.0", "GPLv2 or later", "CC BY-NC-SA 4.0 license") for c in ("All rights reserved.", "BSD 3-Clause license", "nothing")]
    got = {r.doc_id: r for r in licenses.scan(brute.frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))) + " "
        found = [(norm[: m.start()].count(" "), norm[: m.end()].count(" "), r.priority, n, r.label) for n, r in enumerate(every) for m in re.finditer(r.pattern, norm)]
        stays = [x for x in found if not any(y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and ((y[0], -y[1], y[2], y[3]) < (x[0], -x[1], x[2], x[3])) for y in found)]
        base = set(filter(None, brute.licenses(text)[4].split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | {x[4] for x in stays}, text
        best = min([x[2] for x in stays] + ([2] if base else []), default=None)
        assert got[i].score == (licenses.CONFIDENCE[best] if best else 0.0), text


def test_gate_words_come_before_the_keywords(spark, monkeypatch):
    """Keywords are searched in texts with a gate word only: here there are none, so a pattern that matches everything changes nothing."""
    texts = ["the copyright of nothing", "warranted and dedicated", "plain words", "", "under the mit license"]
    docs = brute.frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    usual = sorted(tuple(r) for r in licenses.scan(docs).collect())
    asked = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in asked
    monkeypatch.setattr(licenses, "PREFILTER", "")
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == usual
    assert {w for r in licenses.rules() for w in r.gate.split("|")} <= set(licenses._gates(licenses.rules()))
    assert {"under", "the", "mit", "license"} <= set(licenses._gates([]))
