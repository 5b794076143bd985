"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op10_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""

# The generated pages name no canonical or refresh target, so spellings are the only links here;
# links from html are tested against brute force on a fixture.
SQL["op2_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS kept
  FROM p),
s AS (
  SELECT *, 'https://' || regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS plain
  FROM q WHERE strpos(url, '://') > 0),
edges AS (
  SELECT DISTINCT url AS u, plain AS v FROM s WHERE url <> plain
  UNION SELECT DISTINCT plain, url FROM s WHERE url <> plain),
reach(node, other) AS (
  SELECT u, u FROM edges
  UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
nodes AS (SELECT url FROM s UNION SELECT node FROM roots),
parts AS (
  SELECT url, translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path
  FROM nodes),
rules(h, r, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (
  SELECT parts.url, arg_max(h || r, length(h || r)) AS rule, arg_max(verdict, length(h || r)) AS rule_verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r) GROUP BY parts.url),
all_nodes AS (
  SELECT n.url, rule, rule_verdict, coalesce(root, n.url) AS root
  FROM nodes n LEFT JOIN ruled USING (url) LEFT JOIN roots ON node = n.url),
said AS (SELECT root, max((rule_verdict = 'allow')::INT) AS some_allow FROM all_nodes WHERE rule IS NOT NULL GROUP BY root)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN some_allow = 0 THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN some_allow = 0 THEN 'alias'
            WHEN some_allow = 1 THEN 'allowed alias' ELSE 'none' END AS decided_by,
       root AS alias_of
FROM q LEFT JOIN all_nodes USING (url) LEFT JOIN said USING (root)
"""

# One statement for the mix of any frame; the pipeline uses it on what its earlier stages keep.
MIX = r"""
d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM {docs}),
per AS (SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS cls
        FROM d GROUP BY source),
wgt AS (SELECT *, [5, 2, 1][cls + 1]::HUGEINT AS w FROM per),
lvl AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
                  ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
               sum(w) OVER () - coalesce(sum(w) OVER (
                  ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w,
               row_number() OVER (ORDER BY source_size::DOUBLE / w, source) AS nth FROM wgt),
stop AS (SELECT rest, open_w FROM lvl WHERE 3 * source_size * open_w >= w * rest ORDER BY nth LIMIT 1),
tgt AS (SELECT source, source_size, cls, CASE WHEN 3 * source_size * open_w < w * rest THEN (3 * source_size)::DOUBLE
               ELSE (w * rest)::DOUBLE / open_w::DOUBLE END AS target FROM wgt, stop),
opn AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM tgt),
run AS (SELECT d.*, source_size, cls, target, whole, target - (whole * source_size)::DOUBLE AS open,
               coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN opn ON d.source IS NOT DISTINCT FROM opn.source),
ext AS (SELECT *, before + size <= open AS extra FROM run),
gap AS (SELECT source, any_value(open) - coalesce(sum(size) FILTER (extra), 0) AS gap, coalesce(sum(size) FILTER (extra), 0) AS first
        FROM ext GROUP BY source),
-- round by round: the documents before the first one that crosses the gap, among those that fit it
fill AS (
  SELECT e.source, k, doc_id, size, gap, first AS base, coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY k, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM ext e JOIN gap g ON e.source IS NOT DISTINCT FROM g.source WHERE NOT extra AND size > 0 AND size <= gap
  UNION ALL
  SELECT source, k, doc_id, size, gap, base, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  FROM (SELECT source, k, doc_id, size, gap - got AS gap, base + got AS base
        FROM (SELECT *, sum(CASE WHEN pre + size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source) AS got FROM fill)
        WHERE pre + size > gap AND size <= gap - got)),
fills AS (SELECT source, k, size, base + pre AS fill_at FROM fill WHERE pre + size <= gap),
fin AS (SELECT g.source, first + coalesce(sum(size), 0) AS extra_sum
        FROM gap g LEFT JOIN fills f ON g.source IS NOT DISTINCT FROM f.source GROUP BY g.source, first),
cop AS (SELECT e.*, whole + (extra OR fill_at IS NOT NULL)::BIGINT AS copies, (whole * source_size + extra_sum)::DOUBLE AS all_words,
               coalesce(fill_at, before) AS extra_at
        FROM ext e JOIN fin f ON e.source IS NOT DISTINCT FROM f.source
        LEFT JOIN fills x ON e.source IS NOT DISTINCT FROM x.source AND e.k = x.k)
"""

SQL["op6_mixing"] = "WITH RECURSIVE " + MIX.format(docs="documents") + r""",
u AS (SELECT *, CASE WHEN copies = 0 THEN NULL WHEN all_words > 0 THEN
        (((CASE WHEN whole > 0 THEN before ELSE extra_at END)::DOUBLE + size / 2.0::DOUBLE) / all_words) ELSE 0.0 END AS u FROM cop)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN u IS NULL THEN NULL WHEN u > 1 THEN 1.0 ELSE least(greatest(CASE cls
         WHEN 0 THEN u WHEN 1 THEN sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0.0)) - 0.5::DOUBLE
         ELSE (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * u, 0.0)) - 1.5::DOUBLE) / -1.0::DOUBLE END, 0.0), 1.0) END::DOUBLE AS position
FROM u
"""

SQL["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256, scale: int = 1024) -> str:
    """Every round spelled out: all distances, the nearest entries, the floors of the averages."""
    out = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, p, w[p * len(w) // {parts} + 1 : (p + 1) * len(w) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, e, v AS c FROM cut JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        out.append(f"""
d{r} AS MATERIALIZED (
  SELECT vec_id, p, v, e, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d FROM cut JOIN c{r} USING (p)),
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{r} GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(f"""
m{r} AS (SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, e, i),
n{r} AS (SELECT p, e, list(x ORDER BY i) AS c FROM m{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (p, e))""")
    return "WITH" + ",".join(out) + f""",
books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM c{rounds})),
one AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM one JOIN kept USING (vec_id), books
"""


SQL["op11_vector_codes"] = _vector_codes()


# The trees level by level; CRC-32 spelled out, because DuckDB has no such function.
SQL["op12_merkle"] = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) AS crc
  FROM documents),
leaf AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
         sha256(head || coalesce(strlen((n_chars + t)::VARCHAR) || ':' || (n_chars + t), '-') || tail) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS t FROM f)),
node(g, lvl, i, n, h) AS (
  SELECT g, 0, i, n, h FROM leaf
  UNION ALL
  SELECT g, max(lvl) + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY g, i // 2),
sub AS MATERIALIZED (SELECT g, lvl, h, count(*) OVER () AS groups FROM node WHERE n = 1),
high(lvl, i, n, h) AS (
  SELECT 0, g, groups, h FROM sub
  UNION ALL
  SELECT max(lvl) + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY i // 2),
way AS (
  SELECT l.doc_id, l.g, o.lvl, o.h, (l.i >> o.lvl) % 2 AS side
  FROM leaf l JOIN sub s ON s.g = l.g JOIN node o ON o.g = l.g AND o.lvl < s.lvl AND o.i = xor(l.i >> o.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.g, s.lvl + o.lvl, o.h, (l.g >> o.lvl) % 2
  FROM leaf l JOIN sub s ON s.g = l.g JOIN high o ON o.n > 1 AND o.i = xor(l.g >> o.lvl, 1)),
proof AS MATERIALIZED (SELECT doc_id, sha256(string_agg(h, '' ORDER BY lvl)) AS p FROM way GROUP BY doc_id),
total AS (SELECT max(lvl) AS top FROM high),
folded(doc_id, g, lvl, h) AS (
  SELECT doc_id, g, 0, claimed FROM leaf
  UNION ALL
  SELECT d.doc_id, d.g, d.lvl + 1, sha256(CASE WHEN w.h IS NULL THEN d.h WHEN w.side = 1 THEN w.h || d.h ELSE d.h || w.h END)
  FROM folded d JOIN sub s ON s.g = d.g JOIN total ON d.lvl < s.lvl + top LEFT JOIN way w ON w.doc_id = d.doc_id AND w.lvl = d.lvl)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, z.h AS folded_root, z.h = r.h AS verified
FROM leaf l JOIN sub s ON s.g = l.g JOIN high r ON r.n = 1 LEFT JOIN proof p ON p.doc_id = l.doc_id
JOIN total ON true JOIN folded z ON z.doc_id = l.doc_id AND z.lvl = s.lvl + top
"""
