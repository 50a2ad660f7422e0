"""Codecs on DataFrames: a payload for each unit and block of rows, decoding, evaluation, range filters over packed blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.codecs import reorder
from strandline.codecs.floats import Binary, BytePlanes, Decimal, PiecewiseLinear, QuantizedDelta, RawDouble, smallest
from strandline.codecs.integers import LEVELS, DeltaBits, DeltaOfDelta, DeltaVarint, OutlierBits, Runs, Smallest, at_level


class Reorder:
    name = "reorder"

    def encode(self, x):
        return reorder.encode_doubles(x)

    def decode(self, data):
        return reorder.decode_doubles(data)


class Whole:
    """An integer codec on doubles that are whole numbers."""

    def __init__(self, name: str, codec):
        self.name, self.codec = name, codec

    @staticmethod
    def _integers(x) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if (x != np.rint(x)).any():
            raise ValueError("the values aren't whole")
        return x.astype(np.int64)

    def encode(self, x):
        return self.codec.encode(self._integers(x))

    def shorter(self, x, most: int | None, tried: set[type]) -> bytes | None:
        """encode(x), if it is shorter than most; tried: the codecs that were tried on x already."""
        return (self.codec if isinstance(self.codec, Smallest) else Smallest([self.codec])).shorter(self._integers(x), most, tried)

    def decode(self, data):
        return self.codec.decode(data).astype(np.float64)


def codec_of(name: str, tolerance: float = 0.0):
    """The codecs by name; `adaptive` and levels choose by block."""
    made: dict[str, Callable] = {
        "piecewise_linear": lambda: PiecewiseLinear(tolerance), "quantized_delta": lambda: QuantizedDelta(tolerance), "binary": Binary, "decimal": Decimal, "raw": RawDouble,
        "byte_planes": BytePlanes, "reorder": Reorder, "delta_varint": lambda: Whole("delta_varint", DeltaVarint()), "second_difference": lambda: Whole("second_difference", Smallest()),
        "delta_bits": lambda: Whole("delta_bits", DeltaBits()), "delta_of_delta": lambda: Whole("delta_of_delta", DeltaOfDelta()), "outlier_bits": lambda: Whole("outlier_bits", OutlierBits()), "runs": lambda: Whole("runs", Runs()),
        **{f"level_{k}": (lambda k=k: Whole(f"level_{k}", at_level(k))) for k in LEVELS},
    }
    if name not in made:
        raise ValueError(f"no codec {name}; there are {', '.join(sorted(made))}")
    return made[name]()


#: Values of payloads that are sent on together, about.
_HELD = 1 << 16
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
_PACKED = "codec string, n int, minimum double, maximum double, payload binary"


def _changes(a: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and so are NaNs."""
    if pa.types.is_nested(a.type):
        told = a.to_pylist()
        return np.array([x != y for x, y in zip(told, told[1:], strict=False)], bool)
    x, y = a[:-1], a[1:]
    found = pc.fill_null(pc.not_equal(x, y), True)
    both = pc.and_(pc.is_null(x, nan_is_null=True), pc.is_null(y, nan_is_null=True))
    if pa.types.is_floating(a.type):
        both = pc.and_(both, pc.equal(pc.is_null(x), pc.is_null(y)))
    return pc.and_not(found, both).to_numpy(zero_copy_only=False)


def _each_block(df: DataFrame, unit: str, row: str, value: str, block: int, told: Callable, schema: str) -> DataFrame:
    """A row for each block of rows of a unit: unit, block and what told(rows, values) says, as in schema; rows and values come in order.

    Units may be many and short, so a task takes all blocks of its share in one stream, sorted, and finds them by where unit or block change, instead of being handed each as a
    frame of its own; only a block that a batch cuts is kept. As many tasks as shuffles have: the rows are few bytes, but packing is work.
    """
    kind = df.schema[unit].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, cut, kept = None, None, []  # cut: unit and block that may go on; kept: its rows and values so far

        def made(keys: list, rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            units = pa.concat_arrays([k[0] for k in keys])
            return pa.RecordBatch.from_arrays([units, pa.array([k[1] for k in keys], pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["unit", "block", *names])

        def whole(parts: list) -> tuple:
            r, v = zip(*parts, strict=True)
            return told(np.concatenate(r), np.concatenate(v))

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [_ARROW[part.split()[1]] for part in schema.split(", ")]
            u, b = batch.column("unit"), batch.column("block")
            r, v = batch.column("r").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(_changes(u) | _changes(b)) + 1).tolist(), len(r)]
            keys, rows, start = [], [], 0
            for end in ends:
                key = (u[start : start + 1], b[start].as_py())
                if cut is not None and (cut[1] != key[1] or _changes(pa.concat_arrays([cut[0], key[0]]))[0]):
                    keys.append(cut)
                    rows.append(whole(kept))
                    kept = []
                cut = key
                kept.append((r[start:end], v[start:end]))
                start = end
            if rows:
                yield made(keys, rows)
        if cut is not None:
            yield made([cut], [whole(kept)])

    view = df.select(F.col(unit).alias("unit"), F.floor(F.col(row) / block).alias("block"), F.col(row).cast("long").alias("r"), F.col(value).cast("double").alias("v"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return view.repartition(parts, "unit", "block").sortWithinPartitions("unit", "block", "r").mapInArrow(run, f"unit {kind}, block bigint, {schema}")


def compress(df: DataFrame, unit: str, row: str, value: str, codecs: list[str], tolerance: float = 0.0, block: int = 1024) -> DataFrame:
    """(unit, block, start, codec, n, minimum, maximum, payload): the shortest payload of each block of rows of a unit.

    Blocks are row // block, so a unit of any length spreads over tasks; row numbers count within a unit or in all. minimum and maximum are those
    of the decoded values, so a filter on them never prunes a block with a decoded match.
    """
    made = [codec_of(c, tolerance) for c in codecs]

    def pack(r: np.ndarray, x: np.ndarray) -> tuple:
        name, payload = smallest(x, made)
        back = next(c for c in made if c.name == name).decode(payload)
        return int(r[0]), name, len(x), float(back.min()), float(back.max()), payload

    return _each_block(df, unit, row, value, block, pack, f"start bigint, {_PACKED}")


def decompress(packed: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(unit, block, i, value): the values of each payload by their place in the block."""
    kind = packed.schema["unit"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = {}

        def out(batch: pa.RecordBatch, first: int, values: list) -> pa.RecordBatch:
            sizes = [len(x) for x in values]
            at = pa.array(np.repeat(np.arange(first, first + len(sizes)), sizes))
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            return pa.RecordBatch.from_arrays([batch.column("unit").take(at), batch.column("block").take(at), pa.array(places), pa.array(np.concatenate(values))], ["unit", "block", "i", "value"])

        for batch in batches:
            first, values, held = 0, [], 0
            for k, (codec, payload) in enumerate(zip(batch.column("codec").to_pylist(), batch.column("payload"), strict=True)):
                if codec not in codecs:
                    codecs[codec] = codec_of(codec, tolerance or 1.0)
                x = codecs[codec].decode(payload.as_py())
                values.append(x)
                held += len(x)
                if held >= _HELD:
                    yield out(batch, first, values)
                    first, values, held = k + 1, [], 0
            if values:
                yield out(batch, first, values)

    return packed.select("unit", "block", "codec", "payload").mapInArrow(unpack, f"unit {kind}, block bigint, i int, value double")


def range_filter(packed: DataFrame, low: float, high: float, tolerance: float = 0.0) -> DataFrame:
    """Decoded values from low to high; only blocks whose bounds, widened by the tolerance, meet the range are decoded. On Parquet the bounds prune row groups too."""
    if not low <= high:
        raise ValueError("the range is empty")
    near = packed.where((F.col("minimum") <= high + tolerance) & (F.col("maximum") >= low - tolerance))
    return decompress(near, tolerance).where(F.col("value").between(low, high))


def evaluate(df: DataFrame, unit: str, row: str, value: str, codec: str, tolerance: float = 0.0, block: int = 1024) -> DataFrame:
    """(unit, block, codec, n, raw_bytes, packed_bytes, max_error, exact) of each block: packed, unpacked and compared in one task."""
    made = [codec_of(c, tolerance) for c in codec.split("|")]

    def both(_: np.ndarray, x: np.ndarray) -> tuple:
        name, payload = smallest(x, made)
        back = next(c for c in made if c.name == name).decode(payload)
        return name, len(x), 8 * len(x), len(payload), float(np.abs(back - x).max()), bool((back == x).all())

    return _each_block(df, unit, row, value, block, both, "codec string, n int, raw_bytes bigint, packed_bytes bigint, max_error double, exact boolean")
