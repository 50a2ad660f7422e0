"""Plain versions of what the operators compute, and small tables with odd rows."""

from __future__ import annotations

import hashlib
import re

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, t string, fp string"


def frame(spark, rows, schema=DOCS):
    """Rows (doc_id, text, lang, source) with further columns whose names operators use themselves."""
    if schema == DOCS:
        rows = [(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z") for r in rows]
    return spark.createDataFrame(rows, schema)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """Counts by kind and the hash of the base spans."""
    text = text or ""
    found = [[(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6], [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]]
    joined = ",".join(f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in sorted(sum(found, [])))
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest(), joined)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Iterated sharing: what is above its cap stops there, the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def url(text, rules):
    """host, path, rule and its verdict."""
    host = path = ""
    if text is not None and "://" in text:
        rest = text.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict
