"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the vectors, letters in an n-gram, seed of the letters' vectors.
DIMENSIONS, GRAM, SEED = 1024, 3, 17
#: Languages that can be learned; their profiles go to every task (8 KB each).
MAX_LANGUAGES = 2_000
#: Code points of texts encoded at once, and n-grams bound at once.
BATCH, BOUND = 1 << 20, 4096
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: its lower-cased letter, 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        one = chr(point)
        if one.isalpha():
            low = unicodedata.normalize("NFC", one.lower())
            table[point] = ord(low[0])
    return table


@cache
def _vector(point: int, dimensions: int) -> np.ndarray:
    """The random vector, of 1 and -1, of a letter."""
    return np.random.default_rng((SEED, point)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def _bind(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """A row for each n-gram: the product of its letters' vectors, each rotated by its place."""
    points, place = np.unique(grams, return_inverse=True)
    place = place.reshape(grams.shape)
    if len(points) > 20_000:
        _vector.cache_clear()
    vectors = np.stack([_vector(int(p), dimensions) for p in points])
    made = np.ones((len(grams), dimensions), np.int8)
    for i in range(grams.shape[1]):
        made *= np.roll(vectors, grams.shape[1] - 1 - i, axis=1)[place[:, i]]
    return made.astype(np.float32)


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram vectors of each text added up, and its number of n-grams; words are set between blanks, texts without letters have none."""
    codes, owner = [], []
    for i, text in enumerate(texts):
        if text:
            points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            points = np.concatenate(([32], points, [32])).astype(np.uint32)
            points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
            if len(points) > GRAM - 1:
                codes.append(points)
                owner.append(i)
    out, n = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), np.int64)
    if not codes:
        return out, n
    sizes = np.array([len(c) - GRAM + 1 for c in codes])
    flat = np.concatenate(codes).astype(np.uint64)
    ends = np.cumsum(sizes + GRAM - 1)
    starts = np.repeat(ends - sizes - GRAM + 1, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = flat[starts]
    for i in range(1, GRAM):
        grams = (grams << np.uint64(21)) | flat[starts + i]
    which, gram = np.unique(grams, return_inverse=True)
    text = np.repeat(np.array(owner), sizes)
    n += np.bincount(text, minlength=len(texts))
    order = np.argsort(gram, kind="stable")
    gram, text = gram[order], text[order]
    for low in range(0, len(which), BOUND):
        some = which[low : low + BOUND]
        a, b = np.searchsorted(gram, (low, low + len(some)))
        counts = np.bincount(text[a:b] * len(some) + gram[a:b] - low, minlength=len(texts) * len(some)).reshape(len(texts), len(some)).astype(np.float32)
        letters = np.stack([(some >> np.uint64(21 * (GRAM - 1 - i))) & np.uint64((1 << 21) - 1) for i in range(GRAM)], axis=1)
        out += counts @ _bind(letters, dimensions)
    return out, n


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of the batch of about BATCH code points, and at most 512 texts, so that memory doesn't follow the rows."""
    texts, low, size = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        text = text.as_py()
        texts.append(text)
        size += len(text or "")
        if size >= BATCH or len(texts) >= 512:
            yield low, i + 1, texts
            texts, low, size = [], i + 1, 0
    if texts:
        yield low, batch.num_rows, texts


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has seen of each language: the sum of its texts' bundles, each by its number of n-grams."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for low, high, texts in _grouped(batch):
            made, n = bundles(texts)
            made /= np.maximum(n, 1)[:, None]
            own = np.array(langs[low:high], dtype=object)
            for lang in set(langs[low:high]):
                sums[lang] = sums.get(lang, 0) + made[own == lang].sum(axis=0, dtype=np.float64)
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if sums:
        values = np.concatenate(list(sums.values()))
        lang = np.repeat(np.array(list(sums), dtype=object), DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))), pa.array(values)], ["lang", "i", "x"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their profiles, of rows with text and lang; tasks add up their own rows, so what reaches the driver is a vector for each language."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(_profile, "lang string, i int, x double")
    rows = seen.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("x"))
    found = sorted(((r["lang"], r["x"]) for r in rows.limit(MAX_LANGUAGES + 1).collect()), key=lambda r: r[0].encode())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [lang for lang, _ in found], np.array([x for _, x in found], dtype=np.float64).reshape(len(found), DIMENSIONS)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    Rows whose crc32 of the doc_id isn't 0 modulo 5 (a null doc_id isn't) teach, if they have text and
    lang; lang, source and doc_id aren't read to predict. score is the cosine with the profile that is
    nearest, 0 where it is below; ties go to the smaller language. Texts that are null or have no letter,
    and all if nothing was learned, are `und` with score 0. Letters are compared in lower case; all else
    parts words. Repeated rows repeat.
    """
    langs, profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    profiles = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12) if len(langs) else profiles

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, texts in _grouped(batch):
                made, n = bundles(texts)
                if not langs:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cos = (made @ profiles.T) / np.maximum(np.linalg.norm(made, axis=1), 1e-12)[:, None]
                best = cos.argmax(axis=1)
                names += [langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
                scores += np.where(n > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
