"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import written

#: Fixed masks: a window's words at 1 are hashed, those at 0 may be anything.
MASKS = ("110110011", "111001011", "101011101")
#: Words that are hashed, at most, of each of the parts of an item of which one must be whole.
PART = 4
#: A benchmark item is found at a place where this share of its words stands ...
OVERLAP = 0.8
#: ... or where a stretch, a point for each equal word and -2 for each other, reaches this.
STRETCH = 13
#: Seeds of benchmark items that are broadcast at once (about 100 MB); more go in blocks of items.
MAX_SEEDS = 2_000_000
#: Places (document, item, start) that are broadcast with their items to the documents (some 50 MB).
MAX_PLACES = 100_000
#: Hashes of contaminated texts that are broadcast (some 30 MB); for more the documents are shuffled.
MAX_FOUND = 500_000
#: Windows of a text that are hashed at once.
STRIDE = 256


def _tokens(text: Column) -> Column:
    """Hashes of the words (runs of digits, letters a-z and non-ASCII, lower-cased)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z\\x{80}-\\x{10FFFF}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _hash(tokens: Column, at: Column, mask: str) -> Column:
    """Hash of the words that a mask laid at a position picks."""
    return F.xxhash64(F.lit(mask), *[F.get(tokens, at + i) for i, bit in enumerate(mask) if bit == "1"])


def _windows(rows: DataFrame, masks: tuple[str, ...], keep: list[str]) -> DataFrame:
    """(keep, at, seed) for each window and each mask that fits there; rows have `tokens`.

    Texts are cut into stretches of STRIDE windows first, so what a row carries along is a stretch, not a text.
    """
    reach, n = max(map(len, masks)), F.size("tokens")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / STRIDE).cast("int"))
    cut = rows.where(n >= min(map(len, masks))).select(*keep, F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i * STRIDE + 1, STRIDE + reach - 1))).alias("stretch", "part"))
    places = cut.select("*", F.explode(F.sequence(F.lit(0), F.least(F.size("part"), F.lit(STRIDE)) - 1)).alias("i"))
    part, i = F.col("part"), F.col("i")
    seeds = [F.when(i + len(mask) <= F.size(part), _hash(part, i, mask)) for mask in masks]
    found = places.select(*keep, (F.col("stretch") * STRIDE + i).alias("at"), F.explode(F.array(*seeds)).alias("seed"))
    return found.where(F.col("seed").isNotNull())


def pieces(n: int, overlap: float) -> list[tuple[int, str]]:
    """(position, mask) in an item of n words: wherever a share `overlap` of its words stands, the words of one of them all do.

    With s words changed at most, one of s + 1 parts is whole; where parts are of one or two words, short items get each choice of s words to leave out.
    """
    changed = max(k for k in range(n + 1) if (n - k) / n >= min(overlap, 1.0))
    if changed == n:
        return [(i, "1") for i in range(n)]
    part = n // (changed + 1)
    if changed and part <= 2 and n <= 8:
        masks = ["".join("0" if i in left else "1" for i in range(n)) for left in combinations(range(n), changed)]
        return sorted({(m.index("1"), m.strip("0")) for m in masks})
    return [(i * n // (changed + 1), "1" * min(part, PART)) for i in range(changed + 1)]


def _compared(tokens: Column, at: Column, words: Column) -> Column:
    """(same, stretch): equal words of the item laid at a position, and the best stretch of them."""

    def step(acc: Column, i: Column) -> Column:
        equal = F.coalesce(F.get(tokens, at + i) == F.get(words, i), F.lit(False))
        run = F.greatest(F.lit(0), acc["run"] + F.when(equal, 1).otherwise(-2))
        return F.struct((acc["same"] + equal.cast("int")).alias("same"), run.alias("run"), F.greatest(acc["stretch"], run).alias("stretch"))

    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("run"), F.lit(0).alias("stretch"))
    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, stretch: int = STRETCH, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_id, item_id, items, start, same, item_words, overlap, stretch) for each pair of document and benchmark text found in it.

    Seeds of the benchmark, one for each mask and position and one for each of its pieces, are joined with those of every
    document; around a hit, once for each place, the whole item is laid over the document and equal words are counted, so
    substituted words are tolerated wherever they stand. The pieces leave out no place where the share stands, in items of any length; the
    masks find stretches. start is the first word of the best place, ties to the earliest. Items of equal words are one, that of the smallest item_id; items
    is their number. Null and empty texts and items without words match nothing; rows alike in doc_id and text make one pair,
    texts that share a doc_id or have none each their own; texts are read whole; further columns are ignored. The benchmark's seeds are
    broadcast if they're at most max_seeds; else blocks of them are, one after another. Places are few; they are broadcast to the
    documents if they're at most MAX_PLACES, else joined by a shuffle.
    """
    items = benchmark.select("item_id", _tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))
    items = written(items, "items")
    lengths = [r[0] for r in items.select(F.size("words")).distinct().collect()]  # a few numbers
    cut = [(n, at, mask) for n in lengths for at, mask in pieces(n, overlap)]
    masks = (*MASKS, *sorted({mask for _, _, mask in cut}))
    cut = docs.sparkSession.createDataFrame(cut, "n int, item_at int, mask string")
    of_pieces = items.join(F.broadcast(cut), F.size("words") == F.col("n")).select("item_id", "item_at", F.coalesce(*[F.when(F.col("mask") == m, _hash(F.col("words"), F.col("item_at"), m)) for m in masks]).alias("seed"))
    seeds = _windows(items.withColumnRenamed("words", "tokens"), MASKS, ["item_id"]).select("item_id", F.col("at").alias("item_at"), "seed").unionByName(of_pieces)
    wanted = written(seeds.select("seed", "item_id", "item_at").distinct(), "seeds")
    blocks = -(-wanted.count() // max_seeds)
    name = [F.col("doc_id"), F.xxhash64("text").alias("t")]
    made = docs.where(F.col("text").isNotNull()).select(*name, _tokens(F.col("text")).alias("tokens"))
    spots = _windows(made, masks, ["doc_id", "t"])
    hits = []
    for block in range(blocks):
        some = wanted.where(F.pmod(F.col("seed"), F.lit(blocks)) == block) if blocks > 1 else wanted
        hits.append(spots.join(F.broadcast(some), "seed").select("doc_id", "t", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct())
    kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    if not hits:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind[0]}, item_id {kind[1]}, items bigint, start int, same int, item_words int, overlap double, stretch int")
    hits = written(reduce(DataFrame.unionByName, hits).distinct(), "hits")
    named = hits.join(items, "item_id").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "item_id", "items", "start", "words")
    few = hits.count() <= MAX_PLACES
    same_text = made["doc_id"].eqNullSafe(F.col("_d")) & (made["t"] == F.col("_t"))
    laid = made.join(F.broadcast(named) if few else named, same_text).select("doc_id", "t", "item_id", "items", "start", F.size("words").alias("item_words"), _compared(F.col("tokens"), F.col("start"), F.col("words")).alias("c"))
    share = F.col("c.same") / F.col("item_words")
    best = (
        laid.where((share >= overlap) | (F.col("c.stretch") >= stretch))
        .select("doc_id", "t", "item_id", "items", "item_words", F.struct(F.col("c.same").alias("same"), F.col("c.stretch").alias("stretch"), (-F.col("start")).alias("from")).alias("place"))
        .groupBy("doc_id", "t", "item_id").agg(F.max("place").alias("best"), F.max("item_words").alias("item_words"), F.max("items").alias("items"))
    )
    return best.select(
        "doc_id", "item_id", "items", (-F.col("best.from")).alias("start"), F.col("best.same").alias("same"), "item_words",
        (F.col("best.same") / F.col("item_words")).alias("overlap"), F.col("best.stretch").alias("stretch"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, stretch: int = STRETCH) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item of the benchmark is found, whatever their doc_id."""
    name = F.xxhash64("text")
    found = overlaps(docs.select(name.alias("doc_id"), "text"), benchmark, overlap, stretch).select(F.col("doc_id").alias("_t")).distinct()
    found = written(found, "found")
    found = F.broadcast(found) if found.count() <= MAX_FOUND else found
    rows = docs.select(F.coalesce(name, F.lit(0)).alias("_t"), F.struct("*").alias("_row"))
    return rows.join(found, "_t", "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
