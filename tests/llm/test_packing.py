"""Packing: round trip against the tokenizer, the level array against plain sums of squares."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing
from strandline.session import table


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, wanted, length):
    """wanted: ids of each document. Every id lies in one piece, sums and offsets are right; returns the fills of the sequences."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(wanted)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(wanted[doc])
            assert r.ids_crc32 == zlib.crc32(wanted[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(wanted[doc])
    fills = []
    for spans in by_seq.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert 0 < at <= length
        fills.append(at)
    return fills


@pytest.mark.parametrize(("length", "block"), [(2048, 1 << 15), (64, 100), (7, 50)])
def test_round_trip(spark, sf_dir, tokenizer, length, block):
    docs = table(spark, sf_dir, "documents")
    docs = docs if length > 64 else docs.where("n_chars < 3000")
    wanted = {r.doc_id: ids(tokenizer, r.text) for r in docs.collect()}
    fills = check(packing.pack(docs, length, block).collect(), wanted, length)
    assert sum(n < length for n in fills) <= 1


def test_odd_rows(spark, tokenizer):
    texts = [None, "", " " * 9000, "a" * 30_000, "<|endoftext|>", "x", "x", "née 🙂 " * 700]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, sequence string, offset int, row int")
    fills = check(packing.pack(docs).collect(), {i: ids(tokenizer, t) for i, t in enumerate(texts)}, 2048)
    assert sum(n < 2048 for n in fills) == 1
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b")] * 3 + [(5, "a b")] * 2, "doc_id long, text string"))
    assert sorted((r.doc_id, r.length) for r in twice.where("doc_id = 5").collect()) == [(5, 3), (5, 3)] and twice.where("doc_id IS NULL").count() == 3
    slow = packing.pack(docs, ranks=None)  # the tokenizer itself, as beyond long white space
    assert sorted(map(tuple, slow.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, packing.pack(docs).select("doc_id", "start", "ids_crc32").collect()))


def test_level_array():
    """Each choice is one of those with the least sum of squares of all levels."""
    rng = np.random.default_rng(3)
    for length, n in ((5, 60), (20, 200), (50, 300)):
        sizes = rng.integers(1, length, n)
        sequence, offset = packing.sum_of_squares(sizes, length)
        fill: dict[int, int] = {}
        for s, name, at in zip(sizes.tolist(), sequence.tolist(), offset.tolist(), strict=True):
            assert fill.get(name, 0) == at and at + s <= length
            levels = np.bincount([f for f in fill.values() if f < length], minlength=length + 1)

            def after(h, s=s, levels=levels, length=length):
                new = levels.copy()
                new[h] -= h > 0
                new[h + s] += h + s < length
                return int((new**2).sum())

            best = min(after(h) for h in [0, *(h for h in range(1, length - s + 1) if levels[h])])
            assert after(at) == best
            fill[name] = at + s


def test_little_is_left_open():
    sizes = np.random.default_rng(5).integers(1, 100, 20_000)
    sequence, _ = packing.sum_of_squares(sizes, 100)
    assert 100 * (sequence.max() + 1) / sizes.sum() < 1.02  # sizes of all kinds: the waste grows with the root of their number
