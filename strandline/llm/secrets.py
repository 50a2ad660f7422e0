"""Secret scans: certain spans by pattern, weak ones when complementary parts stand in their scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import before, blocks, let, spans

#: Kinds in the order in which equal starts are listed: the base ones, then what linking adds.
KINDS = ("assign", "access", "hex", "key", "short", "user", "endpoint")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak candidates: each alone is too common to report.
KEY = "(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
USER = "(?i)\\b(user(?:name)?|login|client_?id|account(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9._@+-]{3,})"
ENDPOINT = "(?i)\\b[a-z][a-z0-9+.-]{1,15}://[^\\s\"'<>]{4,}"
#: Only texts with one of these can hold complementary parts.
_PARTS = "(?i)AKIA|(?:password|passwd|secret|token|api_?key|user(?:name)?|login|client_?id|account(?:_?id)?)[\"']?\\x20*[:=]"
#: Code points that parts of one credential may lie apart.
SCOPE = 200
LEAST = 6


def _base(text: Column) -> dict[str, Column]:
    """Spans by base kind; the cheap tests come first, so that few texts are searched for offsets."""
    none = F.array().cast("array<struct<start:int,stop:int,part:string>>")
    assign = F.when(text.rlike(ASSIGN), spans(text, ASSIGN, 2)).otherwise(none)
    return {
        "assign": F.filter(assign, lambda x: F.length(x["part"]) >= LEAST),
        "access": F.when(text.rlike(ACCESS), spans(text, ACCESS)).otherwise(none),
        "hex": F.when(text.rlike(HEX), spans(text, HEX)).otherwise(none),
    }


def _listed(kind: str, found: Column) -> Column:
    n = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["stop"].alias("stop")))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["n"] + 1), x["start"], x["stop"])), ",")


def linked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, found): the weak spans, as structs (start, n, stop), that complementary parts confirm.

    docs: key, text. A `key` (40 mixed base64 characters) needs an access identifier within the scope, a
    `short` (an assignment under six characters) an access identifier, a user or an endpoint, a `user`
    a secret, an `endpoint` both a secret and an identifier. The interval join of parts of one text within
    the scope is one ordered pass each way: of each role the nearest part before and after decides, so
    texts with many parts make no pairs.
    """
    text = F.col("text")
    base = _base(text)
    short = F.filter(F.when(text.rlike(ASSIGN), spans(text, ASSIGN, 2)), lambda x: F.length(x["part"]) < LEAST)
    found = {**base, "key": spans(text, KEY), "short": short, "user": spans(text, USER), "endpoint": spans(text, ENDPOINT)}
    weak = F.concat(*[_listed(k, v) for k, v in found.items() if k not in base])
    strong = F.concat(*[_listed(k, v) for k, v in base.items()])
    parts = (
        docs.select("key", weak.alias("weak"), strong.alias("strong"))
        .where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1))
        .select("key", F.explode(F.concat("weak", "strong")).alias("x"))
        .select("key", "x.start", "x.n", "x.stop")
        .distinct()  # repeated rows share a key
    )
    n = F.col("n")
    of = lambda *kinds: n.isin(*[KINDS.index(k) for k in kinds])
    roles = {"access": of("access"), "user": of("user"), "endpoint": of("endpoint"), "secret": of("assign", "hex", "key", "short")}
    order = Window.partitionBy("key").orderBy("start", "n", "stop")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role, is_one in roles.items():
        before = F.max(F.when(is_one, F.col("stop"))).over(past)
        after = F.min(F.when(is_one, F.col("start"))).over(ahead)
        near[role] = F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("stop") <= scope, F.lit(False))
    parts = parts.select("*", *[near[r].alias(r) for r in roles])
    holds = (
        (of("key") & F.col("access"))
        | (of("short") & (F.col("access") | F.col("user") | F.col("endpoint")))
        | (of("user") & F.col("secret"))
        | (of("endpoint") & F.col("secret") & (F.col("access") | F.col("user")))
    )
    return parts.where(holds).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "n", "stop"))).alias("found"))


def _key(docs: DataFrame) -> Column:
    """A key of texts that may hold parts, alike for repeated rows only; others get one that spreads them."""
    n = F.xxhash64("doc_id", F.length("text"))
    return F.when(F.coalesce(F.col("text").rlike(_PARTS), F.lit(False)), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))).otherwise(F.concat(F.lit("-"), n.cast("string")))


def _found(docs: DataFrame, keep: list[str], scope: int) -> DataFrame:
    gated = docs.where(F.col("text").rlike(_PARTS)).select(_key(docs).alias("key"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = {k: _listed(k, v) for k, v in _base(text).items()}
    base = docs.select(*keep, _key(docs).alias("_key"), *[v.alias(f"_{k}") for k, v in listed.items()])
    both = base.join(linked(gated, scope).withColumnsRenamed({"key": "_key", "found": "_found"}), "_key", "left")
    ours = F.sort_array(F.concat("_assign", "_access", "_hex"))
    return both.withColumn("_base", ours).withColumn("_all", F.when(F.col("_found").isNull(), F.col("_base")).otherwise(F.sort_array(F.concat("_base", "_found"))))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    Null and empty texts have no spans; repeated rows repeat; equal starts are listed in the order of
    KINDS. Base spans may overlap those of another kind and all stay. Texts and spans of any length are taken whole; further columns are ignored. Texts are not shuffled: linking moves the
    parts of texts that hold some, and rows without text carry its result back.
    """
    found = _found(docs, ["doc_id"], scope)
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_all")).alias("spans"),
    )


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with a mask in place of each run of the sorted spans.

    A span opens a run if it starts after the furthest stop of all before it; the run ends where the next one's text begins. Runs are
    cut out in blocks of blocks, each from the stretch of the text that its block has taken, as the n-th character is found by counting.
    """
    reach = before(F.transform(found, lambda x: x["stop"]), lambda a, b: F.greatest(a, b))
    opens = F.filter(F.zip_with(found, reach, lambda x, r: F.struct(r.alias("a"), x["start"].alias("z"), ((r == 0) | (x["start"] > r)).alias("new"))), lambda x: x["new"])

    def cut(t: Column, start: Column, runs: Column, part: Callable[[Column, Column, Column], Column]) -> Column:
        """The pieces of runs, joined; t: the text from start on."""
        return F.array_join(F.transform(runs, lambda x: part(t, start, x)), mask)

    def within(ends: Callable[[Column], tuple[Column, Column]], part: Callable[[Column, Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
        def f(t: Column, start: Column, x: Column) -> Column:
            a, z = ends(x)
            return let(F.struct(F.substr(t, a - start + 1, z - a).alias("t"), a.alias("a"), x.alias("x")), lambda own: cut(own["t"], own["a"], own["x"], part))

        return f

    one = lambda t, start, x: F.substr(t, x["a"] - start + 1, x["z"] - x["a"])
    few = within(lambda p: (F.element_at(p, 1)["a"], F.element_at(p, -1)["z"]), one)
    many = within(lambda q: (F.element_at(F.element_at(q, 1), 1)["a"], F.element_at(F.element_at(q, -1), -1)["z"]), few)
    kept = let(opens, lambda xs: F.array_join(F.transform(blocks(blocks(xs)), lambda q: many(text, F.lit(0), q)), mask))
    last = F.array_max(F.transform(found, lambda x: x["stop"]))
    return F.concat(kept, F.lit(mask), F.substr(text, last + 1, F.length(text)))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with each span, or each run of overlapping spans, of its text replaced by the mask; n_chars, if there, follows.

    Texts without spans, null and empty ones stay as they are, and so do every row and all other columns, whatever their names.
    """
    found = _found(docs.select("doc_id", "text", F.struct("*").alias("_row")), ["text", "_row"], scope)
    found = found.withColumn("_masked", F.when(F.size("_all") == 0, F.col("text")).otherwise(_masked(F.col("text"), F.col("_all"), mask)))

    def column(c: str) -> Column:
        old = F.col("_row").getField(c)
        if c == "text":
            return F.col("_masked").alias(c)
        if c == "n_chars":
            return F.when(F.size("_all") == 0, old).otherwise(F.length("_masked").cast(docs.schema[c].dataType)).alias(c)
        return old.alias(c)

    return found.select(*[column(c) for c in docs.columns])
