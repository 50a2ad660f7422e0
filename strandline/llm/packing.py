"""Packing of token sequences by sum-of-squares online packing."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.scan import running_sum
from strandline.session import written

#: Ids that a sequence holds at most; the id that ends a document.
LENGTH, END = 2048, 1
#: Rests of documents, or part-filled sequences, that one level array packs.
BLOCK = 1 << 15
#: The tokenizer, and its vocabulary as ranks for the faster library, which gives the same ids.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: A run of white space on which the faster library's pattern may fail.
_LONG_BLANK = re.compile(r"\s{4096}")


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


@cache
def _fast(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, tokenizer: str, ranks: str | None) -> np.ndarray:
    """Ids of a whole text and the END id. Texts with long runs of white space, or all if ranks is None, go to the tokenizer itself."""
    text = text or ""
    if ranks is None or (len(text) >= 4096 and _LONG_BLANK.search(text)):
        ids = _slow(tokenizer).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(ranks).encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items of 1 to length - 1 ids, in the order given.

    levels[h]: part-filled sequences that hold h ids. An item of size s opens a sequence or lies in one of fill h, so that the sum of
    the squares of levels becomes least: of all h with levels[h] > 0 the sum changes by 2 (levels[h + s] - levels[h] + 1), or by
    1 - 2 levels[h] if that fills the sequence; a new one changes it by 2 levels[s] + 1. Ties go to the fullest; the last sequence of a fill is taken.
    """
    levels = np.zeros(length + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(length)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened, never = 0, np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        now = levels[1 : length - s + 1]
        change = 2 * (levels[1 + s : length + 1] - now + 1)
        change[-1] = 1 - 2 * now[-1]  # full ones aren't counted
        change[now == 0] = never
        best = len(change) - 1 - int(change[::-1].argmin())
        if change[best] > 2 * levels[s] + 1:
            h, name = 0, opened
            opened += 1
        else:
            h = best + 1
            levels[h] -= 1
            name = held[h].pop()
        if h + s < length:
            levels[h + s] += 1
            held[h + s].append(name)
        sequence[i], offset[i] = name, h
    return sequence, offset


_PIECE = "piece bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(docs: DataFrame, length: int, tokenizer: str, ranks: str | None) -> DataFrame:
    """A row for each full sequence that a document fills alone, and for its rest, whose ids are kept (tail)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), tokenizer, ranks)
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    n = len(raw) // 4
                    out.append((doc, start, n, zlib.crc32(raw), len(ids), raw if n < length else None))
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail"]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return told.mapInArrow(cut, _PIECE.removeprefix("piece bigint, ") + ", tail binary").withColumn("piece", F.monotonically_increasing_id())


def _packed(length: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """The sequences of the block become items; what lay in one stays together and in its order."""
        name = rows.column("sequence").to_numpy()
        end = rows.column("offset").to_numpy() + rows.column("length").to_numpy()
        known, item = np.unique(name, return_inverse=True)
        size = np.zeros(len(known), np.int64)
        np.maximum.at(size, item, end)
        order = np.random.default_rng(len(known)).permutation(len(known))  # names follow the input, whose order may follow sizes
        made, at = np.empty_like(size), np.empty_like(size)
        made[order], at[order] = sum_of_squares(size[order], length)
        first = np.zeros(made.max() + 1, np.int64)
        first[made[at == 0]] = known[at == 0]  # a sequence is named after the one at its start
        fill = np.zeros(len(first), np.int64)
        np.maximum.at(fill, made, at + size)
        columns = {"sequence": first[made][item], "offset": rows.column("offset").to_numpy() + at[item], "fill": fill[made][item]}
        for c, x in columns.items():
            rows = rows.set_column(rows.column_names.index(c), c, pa.array(x))
        return rows

    return pack


def pack(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, tokenizer: str | None = None, ranks: str | None = "") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): all documents in sequences of at most `length` ids, a row for each piece.

    A document is its ids and the END id (null text: END alone; empty too); each row of docs is one, whether or not its doc_id is null or repeats.
    A document fills whole sequences alone as long as it can; its rest is an item. Blocks of about `block` items are packed by
    `sum_of_squares`, each with its own level array; the sequences that stay part-filled are the items of a next round, in fewer blocks, until
    there is one block or a round fills less than a tenth of them. Those left are laid end to end, along one running sum, and cut at each
    multiple of `length`; so one sequence of all is padded. Texts of any length are encoded whole, by one task; columns but doc_id and text are
    ignored. An empty table gives no rows. tokenizer, ranks: files (None for ranks: no faster library; '': the public ones).
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    ranks = public_tokenizers.path(RANKS) if ranks == "" else ranks
    whole = written(_pieces(docs, length, tokenizer, ranks), "pieces")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    shown = [*kept, F.col("sequence").alias("sequence_id"), "offset"]
    zero = F.lit(0).cast("long").alias("offset")
    # a sequence has the number of the piece at its start; those laid end to end have numbers below 0
    placed = whole.where(F.col("length") == length).select(*kept, F.col("piece").alias("sequence_id"), zero)
    rests = whole.where(F.col("length") < length)
    open_ = rests.select("piece", F.col("piece").alias("sequence"), "length", zero, F.col("length").alias("fill"))
    kind = "piece bigint, sequence bigint, length bigint, offset bigint, fill bigint"
    full, items = [], open_.count()
    while items:
        blocks = -(-items // block)
        dealt = open_.withColumn("_block", F.pmod(F.xxhash64("sequence"), F.lit(blocks)))
        made = written(dealt.groupBy("_block").applyInArrow(lambda k, t: _packed(length)(k, t.drop_columns(["_block"])), kind), "packed", items)
        full.append(made.where(F.col("fill") == length))
        open_ = made.where(F.col("fill") < length)
        left = open_.where(F.col("offset") == 0).count()
        done, items = blocks == 1 or left > 0.9 * items, left
        if done:
            break
    for part in full:
        placed = placed.unionByName(part.drop("length").join(rests, "piece").select(*shown))
    return placed.unionByName(_laid(open_, rests, length)) if items else placed


def _laid(rows: DataFrame, rests: DataFrame, length: int) -> DataFrame:
    """The sequences that no round filled, end to end in the order of their names; pieces that a multiple of length cuts get sums of their own."""
    laid = running_sum(rows, F.col("length"), [], ["sequence", "offset"], "_end")
    laid = laid.withColumn("_at", F.col("_end") - F.col("length"))
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_end") - 1) / length)
    laid = laid.withColumn("_to", F.explode(F.sequence(first, last)))
    low, high = F.greatest("_at", F.col("_to") * length), F.least("_end", (F.col("_to") + 1) * length)
    laid = laid.select("piece", (low - F.col("_at")).alias("_from"), (high - low).alias("_n"), F.col("_to"), (low - F.col("_to") * length).alias("offset"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(batch.column("tail"), batch.column("_from").to_pylist(), batch.column("_n").to_pylist(), strict=True)
            crc = [zlib.crc32(raw.as_py()[4 * a : 4 * (a + n)]) for raw, a, n in at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "_n")], pa.array(crc, pa.int64()), *[batch.column(c) for c in ("doc_tokens", "_to", "offset")]], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    met = laid.join(rests.select("piece", "doc_id", "start", "doc_tokens", "tail"), "piece")
    made = met.select("doc_id", (F.col("start") + F.col("_from")).alias("start"), "_n", "doc_tokens", (-1 - F.col("_to")).alias("_to"), "offset", "tail", "_from")
    return made.mapInArrow(sums, _PIECE.removeprefix("piece bigint, ") + ", sequence_id bigint, offset bigint")
