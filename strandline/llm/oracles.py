"""SQL that gives the rows of the corpus queries, where SQL can."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"coalesce(CASE WHEN contains({url}, '://') THEN translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') END, '')"


def _path(url: str) -> str:
    return f"coalesce(CASE WHEN contains({url}, '://') THEN regexp_extract(substr({url}, strpos({url}, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) END, '')"


def _node(host: str, path: str, url: str) -> str:
    return f"CASE WHEN {host} <> '' THEN concat(regexp_replace({host}, ':(80|443)$', ''), regexp_replace({path}, '/$', ''), regexp_extract({url}, '^[^?#]*(\\?[^#]*)?', 1)) END"


def _rule(host: str, path: str, rules: tuple[tuple[str, str, str], ...], what: int) -> str:
    """CASE over the rules, longest first; what: 0 the rule, 1 its verdict."""
    cases = [f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return f"CASE {' '.join(cases)} END"


def urls(rules: tuple[tuple[str, str, str], ...]) -> str:
    """Rules by CASE; aliases by the transitive closure of the links."""
    link = "regexp_extract(tag, '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    refresh = "regexp_extract(tag, '(?is)url\\s*=\\s*([^\"''\\s>]+)', 1)"
    root = "concat(regexp_extract(url, '^([^:]*):', 1), '://', host)"
    folder = "regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '')"
    return f"""WITH RECURSIVE
h AS (SELECT page_id, url, html, {_host('url')} AS host, {_path('url')} AS path FROM pages),
n AS (SELECT *, {_node('host', 'path', 'url')} AS node, {_rule('host', 'path', rules, 0)} AS rule, {_rule('host', 'path', rules, 1)} AS own FROM h),
tags AS (SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM n WHERE node IS NOT NULL),
hrefs AS (SELECT *, replace({link}, '&amp;', '&') AS link FROM tags WHERE regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')
  UNION ALL SELECT *, replace({refresh}, '&amp;', '&') AS link FROM tags WHERE regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
hops AS (SELECT node, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN concat(regexp_extract(url, '^([^:]*):', 1), ':', link) WHEN starts_with(link, '/') THEN concat({root}, link) ELSE concat({root}, {folder}, link) END AS target FROM hrefs WHERE link <> ''),
ends AS (SELECT node AS a, {_node('h2', 'p2', 'target')} AS b, {_rule('h2', 'p2', rules, 1)} AS own FROM (SELECT node, target, {_host('target')} AS h2, {_path('target')} AS p2 FROM hops)),
e AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
known AS (SELECT node, own FROM n WHERE own IS NOT NULL UNION SELECT b, own FROM ends WHERE own IS NOT NULL),
passed AS (SELECT r.a AS node, min(r.b) AS root, min(CASE k.own WHEN 'allow' THEN 0 WHEN 'block' THEN 1 END) AS best FROM (SELECT a, b FROM reach UNION SELECT a, a FROM e) r LEFT JOIN known k ON k.node = r.b GROUP BY 1)
SELECT n.page_id, n.host, n.path, n.rule, coalesce(n.own, CASE p.best WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict, p.root AS alias_of FROM n LEFT JOIN passed p ON n.node = p.node"""


#: All candidates by brute force; equal to the search's rows where its shortlist finds all of the nearest, as it does where it holds every vector.
NEIGHBOURS = """WITH v AS (SELECT vec_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def _round(i: int) -> str:
    """Centroids after round i + 1 from those before, by assignment of every vector."""
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return f"""a{i} AS MATERIALIZED ({_assigned(i)}),
m{i} AS (SELECT c, j, sum(CAST(v[j] AS HUGEINT)) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(t.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list({mean} ORDER BY j) AS v FROM m{i} GROUP BY c) t ON t.c = c{i}.c)"""


def _assigned(i: int) -> str:
    d = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT row, first(vec_id) AS vec_id, first(v) AS v, first(c ORDER BY d, c) AS c, min(d) AS d FROM (SELECT k.row, k.vec_id, k.v, c.c, CAST({d} AS BIGINT) AS d FROM k, c{i} c) GROUP BY row"


#: All centroids against all vectors, three rounds and once more.
CENTROIDS = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
{", ".join(_round(i) for i in range(3))},
a3 AS MATERIALIZED ({_assigned(3)}), s AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY c)
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a3) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN s ON s.c = a3.c JOIN c3 ON c3.c = a3.c"""


#: All rows against all anchors.
NEGATIVES = """WITH v AS (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.r.label = b.r.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.r.v, b.r.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10"""
