"""SQL for the queries of this subpackage that DuckDB can express."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w),
sets AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
classes AS (SELECT min(doc_id) AS rep, n, sh FROM sets WHERE n > 0 GROUP BY n, sh),
grams AS (SELECT rep, n, unnest(sh) AS g FROM classes),
linked AS (
  SELECT a.rep AS u, b.rep AS v FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, l.v FROM reach r JOIN linked l ON r.other = l.u),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON d.n = c.n AND d.sh = c.sh LEFT JOIN roots r ON r.node = c.rep
"""

_HOST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"


def op5_sql(rules: dict[str, str], blocked_words: tuple[str, ...]) -> str:
    values = ", ".join(
        f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules.items())
    words = ", ".join(f"'{w}'" for w in blocked_words)
    return f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS k,
         translate({_HOST.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         {_HOST.format(2)} AS path FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES {values}),
best AS (
  SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, length(rhost) DESC) AS place
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, b.rule,
  coalesce(b.verdict, CASE WHEN list_has_any(regexp_extract_all(host, '[a-z0-9]+'), [{words}])
                           THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best b ON u.k = b.k AND b.place = 1
"""


OP10 = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS k, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.k, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""


OP11 = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS k, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, q.k, c.vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place FROM s WHERE same
  QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.k = s.k AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_sql(rounds: int, parts: int, entries: int, scale: int) -> str:
    """Lloyd rounds written out, each with its assignment and its moved codebooks."""
    assigned = """a{i} AS MATERIALIZED (
  SELECT k, part, any_value(x) AS x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.k, p.part, p.x, b.entry,
           CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d
    FROM p JOIN b{i} b ON p.part = b.part) GROUP BY k, part)"""
    moved = """b{j} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS x FROM (
      SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS mean FROM (
        SELECT part, entry, pos, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (
          SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM a{i})
        GROUP BY part, entry, pos)) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""
    steps = [assigned.format(i=0)]
    for i in range(rounds):
        steps += [moved.format(i=i, j=i + 1), assigned.format(i=i + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS k,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT k, vec_id, CAST(part AS BIGINT) AS part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
  FROM v, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, k - 1 AS entry, x FROM p WHERE k <= {entries}),
{', '.join(steps)}
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN (
  SELECT k, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY k) c ON v.k = c.k
"""


# Reads pages whose main text is one article of headings and paragraphs.
OP13 = r"""
WITH a AS (
  SELECT page_id, url, row_number() OVER () AS k,
         string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') AS parts
  FROM pages),
b AS (SELECT k, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM a),
c AS (
  SELECT k, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
    '&quot;?', '"', 'g'), '&#x27;', chr(39), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM b),
t AS (SELECT k, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM c WHERE block <> '' GROUP BY k)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
FROM a LEFT JOIN t ON a.k = t.k
"""


def oracle_sql() -> dict[str, str]:
    from riskloom.llm import vector_codes
    from riskloom.llm.queries import URL_RULES
    from riskloom.llm.url_filter import BLOCKED_WORDS

    return {
        "op5_url_digests": op5_sql(URL_RULES, BLOCKED_WORDS),
        "op6_minhash_dedup": OP6,
        "op10_exact_topk": OP10,
        "op11_packed_negatives": OP11,
        "op12_dual_tree_codes": op12_sql(
            vector_codes.ROUNDS, vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE),
        "op13_page_wrappers": OP13,
    }
