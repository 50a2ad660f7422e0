"""Round trips and bounds of the codecs, on fixtures and on random input."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.codecs import bits, frames, reorder
from strandline.codecs import floats as Fl
from strandline.codecs import integers as I

INTEGER = [I.Raw(), I.Runs(), I.DeltaVarint(), I.SecondDifference(), I.DeltaBits(), I.DeltaOfDelta(), I.OutlierBits(), I.Smallest(), *[I.at_level(k) for k in I.LEVELS]]
SQUARES = np.arange(800) ** 2 - 20 * np.arange(800)
int64 = st.integers(-(2**63), 2**63 - 1)
doubles = st.floats(-1e6, 1e6, allow_nan=False)


@pytest.mark.parametrize("codec", INTEGER, ids=lambda c: type(c).__name__)
@given(x=st.one_of(st.lists(int64, max_size=300), st.lists(st.integers(-3, 3), max_size=700)))
@settings(max_examples=25, deadline=None)
def test_integers(codec, x):
    x = np.array(x, np.int64)
    assert (codec.decode(codec.encode(x)) == x).all() and (codec.decode(codec.encode(SQUARES)) == SQUARES).all()


@pytest.mark.parametrize("codec", INTEGER[:7], ids=lambda c: type(c).__name__)
def test_broken_payloads(codec):
    good = codec.encode(SQUARES)
    for bad in (b"", good[:6], b"XXXX" + good[4:], good[:4] + b"\xff\xff\xff\xff" + good[8:]):
        with pytest.raises((ValueError, Exception)):
            codec.decode(bad)
    for x in ([1.5], [True, False], np.array([2**63], np.uint64)):
        with pytest.raises(ValueError):
            codec.encode(x)


def test_inflate_bounds():
    import zlib

    data = zlib.compress(b"x" * 100)
    for bad, most in ((data, 99), (data[:-3], 100), (data + b"y", 100)):
        with pytest.raises(ValueError):
            I.inflate(bad, most)


@given(st.lists(st.tuples(int64, st.integers(0, 5), st.integers(-5, 5)), max_size=600))
@settings(max_examples=20, deadline=None)
def test_reorder(rows):
    a, b, t = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    columns, time = reorder.decode(reorder.encode([a, b], t))
    assert (columns == np.stack([a, b])).all() and (time == t).all()
    columns, time = reorder.decode(reorder.encode([b]))
    assert (columns[0] == b).all() and time is None


def test_reorder_with_equal_times():
    t, a, b = [5, 2, 2, 9, 1, 5, 3, 3], [90, 10, 80, 20, 70, 30, 60, 40], [901, 101, 801, 201, 701, 301, 601, 401]
    columns, time = reorder.decode(reorder.encode([a, b], t))
    assert columns.tolist() == [a, b] and time.tolist() == t
    with pytest.raises(ValueError):
        reorder.encode([a], [1])
    with pytest.raises(ValueError):
        reorder.decode(reorder.encode([SQUARES])[:-9])


@given(st.lists(doubles, max_size=400))
@settings(max_examples=25, deadline=None)
def test_doubles(x):
    x = np.array(x)
    assert (reorder.decode_doubles(reorder.encode_doubles(x)) == x).all()
    for tol in (0.0, 0.05, 3.0):
        p = Fl.PiecewiseLinear(tol)
        y = p.decode(p.encode(x))
        assert len(y) == len(x) and (not len(x) or np.abs(y - x).max() <= tol + 1e-9 * max(1, np.abs(x).max()))
        if tol:
            q = Fl.QuantizedDelta(tol)
            y = q.decode(q.encode(x))
            assert len(y) == len(x) and (not len(x) or np.abs(y - x).max() <= tol + 1e-9 * max(1, np.abs(x).max()))
    d = Fl.Decimal(6)
    assert not len(x) or np.abs(d.decode(d.encode(x)) - x).max() <= 5.1e-7
    b = Fl.BytePlanes(6)
    assert not len(x) or np.abs(b.decode(b.encode(x)) - x).max() <= 5.1e-7


def test_float_fixtures():
    for x in ([40.0, 40.03, 40.07, 40.09, 40.12, 40.15], [], [42.0]):
        p = Fl.PiecewiseLinear(0.05)
        assert not len(x) or np.abs(p.decode(p.encode(x)) - x).max() <= 0.05 + 1e-9
    x = np.round(np.arange(800) / 17, 6)
    assert (reorder.decode_doubles(reorder.encode_doubles(x)) == x).all()
    name, payload = Fl.smallest(np.zeros(5000), [Fl.PiecewiseLinear(0.1), Fl.QuantizedDelta(0.1)])
    assert name == "quantized_delta" or len(payload) < 100


def test_refusals():
    for make in (lambda: Fl.PiecewiseLinear(-1), lambda: Fl.PiecewiseLinear(float("nan")), lambda: Fl.QuantizedDelta(0), lambda: Fl.Decimal(10), lambda: I.at_level(9), lambda: frames.codec_of("none")):
        with pytest.raises(ValueError):
            make()
    for codec in (Fl.PiecewiseLinear(0.1), Fl.QuantizedDelta(0.1), Fl.Binary()):
        for x in ([float("nan")], [True]):
            with pytest.raises(ValueError):
                codec.encode(x)
        with pytest.raises((ValueError, Exception)):
            codec.decode(codec.encode([0.0, 1.0, 1.0])[:-4])
    with pytest.raises(ValueError):
        Fl.Binary().encode([2.0])
    with pytest.raises(ValueError):
        Fl.QuantizedDelta(1e-9).encode([0.0, 1e6])


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 64))
@settings(max_examples=40, deadline=None)
def test_bits(x, w):
    u = np.array(x, np.uint64)
    assert (bits.get_varints(bits.put_varints(u)) == u).all()
    cut = u & np.uint64((1 << w) - 1) if w < 64 else u
    assert (bits.unpack(bits.pack(cut, w), w, len(cut)) == cut).all()
    assert (bits.unzigzag(bits.zigzag(u.view(np.int64))) == u.view(np.int64)).all()


def test_frames(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(32)] + [("b", i, 5.0) for i in range(3)], "unit string, row int, v double")
    packed = frames.compress(df, "unit", "row", "v", ["raw", "reorder"], block=8).cache()
    assert packed.count() == 5
    got = frames.range_filter(packed.where("unit = 'a'"), 10, 12)
    assert sorted(r.value for r in got.collect()) == [10.0, 11.0, 12.0]
    assert packed.where("unit = 'a' and minimum <= 12 and maximum >= 10").count() == 1
    assert frames.decompress(packed).groupBy("unit").count().count() == 2
    with pytest.raises(ValueError):
        frames.range_filter(packed, 2, 1)
    loose = frames.compress(df, "unit", "row", "v", ["quantized_delta"], 0.4, 8)
    near = {r.value for r in frames.range_filter(loose, 10, 12, 0.4).collect()}
    every = {r.value for r in frames.decompress(loose, 0.4).collect()}
    assert near == {x for x in every if 10 <= x <= 12}
    e = frames.evaluate(df, "unit", "row", "v", "piecewise_linear|quantized_delta", 0.05, 16).collect()
    assert all(r.max_error <= 0.05 + 1e-9 for r in e) and sum(r.n for r in e) == 35


@given(st.lists(st.one_of(st.integers(-5, 5), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=512))
@settings(max_examples=50, deadline=None)
def test_sizes_of_bands(x):
    d = np.array(x, np.int64)
    order = np.sort(d)
    for low, high in ((order[0], order[-1]), (order[len(d) // 5], order[len(d) - 1 - len(d) // 5])):
        assert I.OutlierBits._size(d, order, low, high) == len(I.OutlierBits._bands(d, low, high))


def test_blocks_come_in_one_stream(spark):
    """Many short units, null and NaN among them, cut by batches: blocks as a grouping finds them, in as many tasks as shuffles have."""
    n = 4000
    rows = [(None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 500), i, float(i % 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "unit double, row int, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        made = frames.evaluate(df, "unit", "row", "v", "raw", block=1000)
        got = sorted((str(r.unit), r.block, r.n) for r in made.collect())
        tasks = made.rdd.getNumPartitions()
        back = frames.decompress(frames.compress(df, "unit", "row", "v", ["raw"], block=1000)).groupBy("unit", "block").agg({"value": "sum"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for u, i, v in rows:
        at = want.setdefault((str(u), i // 1000), [0, 0.0])
        at[0], at[1] = at[0] + 1, at[1] + v
    assert got == sorted((*k, c[0]) for k, c in want.items()) and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(str(r[0]), r[1]): r[2] for r in back} == {k: c[1] for k, c in want.items()}


def test_levels_try_each_codec_once_and_pack_only_what_may_be_shorter(monkeypatch):
    """Of levels that share codecs each is tried once for a block, and one of which the size tells that it isn't shorter makes no payload; payloads are the shortest all the same."""
    made = []
    for kind in (I.DeltaVarint, I.SecondDifference, I.DeltaBits, I.DeltaOfDelta, I.Runs, I.OutlierBits):
        monkeypatch.setattr(kind, "encode", lambda self, x, kind=kind, encode=I.Codec.encode: (made.append(kind), encode(self, x))[1])
    rng = np.random.default_rng(3)
    levels = [frames.codec_of(f"level_{k}") for k in (0, 3, 5)]
    for n in (1, 2, 40, 700):
        for x in (rng.integers(-500, 500, n), np.arange(n), np.repeat(7, n), np.where(rng.random(n) < 0.05, rng.integers(-(2**45), 2**45, n), rng.integers(0, 9, n))):
            made.clear()
            name, payload = Fl.smallest(x.astype(float), levels)
            assert len(made) == len(set(made)) and (n < 40 or I.Runs not in made or len(np.unique(x)) < n)
            pools = [(f"level_{k}", c.encode(x)) for k in (0, 3, 5) for c in I.LEVELS[k]]
            assert (name, payload) == min(pools, key=lambda p: len(p[1]))


def test_the_size_of_packed_bits_is_known_before_they_are_packed():
    rng = np.random.default_rng(4)
    for n in (2, 3, 129, 130, 515, 1500):
        for x in (rng.integers(-(2**63), 2**63 - 1, n), np.arange(n), np.cumsum(rng.integers(0, 9, n)), np.where(rng.random(n) < 0.1, 2**50, rng.integers(0, 99, n))):
            for codec in (I.DeltaBits(), I.OutlierBits(), I.Raw(), *[I.DeltaOfDelta()] * (n > 2)):
                assert codec.least(x) == len(codec.encode(x))
            assert I.Runs().least(x) <= len(I.Runs().encode(x))
