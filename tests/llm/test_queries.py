"""The registered queries on the smallest tables: columns, rows, and brute force over whole texts."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from strandline.llm import queries, urls
from strandline.session import table

from ..compare import compare, connection
from . import brute

SF = "/root/testdata/sf0.001"
WANTED = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op6_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_passages": {"doc_id": "bigint", "class_id": "bigint", "links": "bigint"},
    "op11_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_centroids": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op10_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text, r.source) for r in table(spark, SF, "documents").collect()}


def op1(rows, texts):
    total = {}
    for text, source in texts.values():
        total[source] = total.get(source, 0) + len((text or "").encode().split())
    want = brute.targets(total)
    assert all(r.source_size == total[texts[r.doc_id][1]] and r.target == pytest.approx(want[texts[r.doc_id][1]]) and r.taken <= 3 * r.size for r in rows)


def op2(rows, texts):
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {d: brute.licenses(t) for d, (t, _) in texts.items()}


def op4(rows, texts):
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == {d: brute.secrets(t)[:4] for d, (t, _) in texts.items()}


def op8(rows, texts):
    prints = {d: brute.simhash(t) for d, (t, _) in texts.items()}
    edges = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = brute.components(edges, prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{f:016x}", root[d]) for d, f in prints.items()}


def op10(rows, spark):
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    for r in rows:
        host, path, rule, verdict = brute.url(pages[r.page_id], urls.RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, connection(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(WANTED))
def test_query(spark, texts, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in WANTED[name]} == WANTED[name]
    rows = df.collect()
    if name in ("op1_mixing", "op2_licenses", "op3_language", "op4_secrets", "op7_toxicity", "op8_simhash"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op6_neighbours":
        n = table(spark, SF, "embeddings").count()
        assert len(rows) == min(20, n - 1) * len({r.query_id for r in rows}) and np.isfinite([r.score for r in rows]).all()
    if name == "op10_urls":
        op10(rows, spark)
    elif name.split("_")[0] in globals() and name != "op10_urls":
        globals()[name.split("_")[0]](rows, texts)
