"""What the queries compute, in SQL, where SQL states it; for whole tables of moderate size."""

from __future__ import annotations

from . import licenses, sharding

_WORDS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"
_RUNS = "[array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]"


def licenses_sql(least: float = licenses.LEAST) -> str:
    values = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in licenses.TEMPLATES)
    return rf"""
WITH t AS (SELECT name, unnest(list_distinct({_RUNS})) AS sh FROM (
       SELECT name, list_filter({_WORDS}, lambda x: x <> '') AS w FROM (VALUES {values}) v(name, text))),
 size AS (SELECT name, count(*) AS n FROM t GROUP BY name),
 d AS (SELECT doc_id, {_RUNS} AS shs FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
 s AS (SELECT doc_id, unnest(shs) AS sh, unnest(range(0, len(shs))) AS pos FROM d),
 hit AS (SELECT doc_id, name, pos, sh FROM s JOIN t USING (sh)),
 region AS (SELECT a.doc_id, a.name, a.pos AS first, count(DISTINCT b.sh) / n AS containment, max(b.pos) + 4 AS last
   FROM hit a JOIN size USING (name) JOIN hit b ON b.doc_id = a.doc_id AND b.name = a.name AND b.pos >= a.pos AND b.pos < a.pos + n + 5
   GROUP BY a.doc_id, a.name, a.pos, n),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY containment DESC, first) AS k
   FROM region WHERE containment >= {least} - 1e-9)
SELECT doc_id, name AS license, containment, CAST(first AS INT) AS first_word, CAST(last AS INT) AS last_word FROM best WHERE k = 1"""


_COMPONENTS = """
 reach(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
 comp AS (SELECT id, least(id, min(other)) AS c FROM reach GROUP BY id)"""

EMBEDDINGS = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 link(a, b) AS (SELECT x.vec_id, y.vec_id FROM e x JOIN e y
   ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
 {_COMPONENTS.strip()},
 n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id"""

PAGES = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest, keeper, payload_bytes >= 1000 AND page_id <> keeper AS again
  FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
               max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages))"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9[:^ascii:]]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct({_RUNS}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
 u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
   FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b, na, nb, c FROM both_ WHERE c >= 0.8 * (na + nb - c) - 1e-9 * (na + nb - c)),
 {_COMPONENTS.strip()},
 n AS (SELECT a AS id, count(*) AS n, min(CASE WHEN c = na AND c = nb THEN b END) AS same FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(same, doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, coalesce(c, doc_id) AS component_id,
       coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN comp ON comp.id = doc_id LEFT JOIN n ON n.id = doc_id"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 k AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
 c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS MATERIALIZED (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM x),
 l AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL),
 q AS (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM l),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
   FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value
   FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
   FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""


_BYTES = "list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))"

RESAMPLING = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
 d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS MATERIALIZED (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
 bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
 u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
 e AS (SELECT w, unnest({_BYTES}) AS byte, unnest(range(0, len(h) // 2)) AS i FROM u),
 hashed(w, i, c) AS (SELECT w, 0, 4294967295 FROM u UNION ALL SELECT s.w, s.i + 1, xor(s.c >> 8, t[(xor(s.c, e.byte) & 255) + 1]) FROM hashed s JOIN e ON e.w = s.w AND e.i = s.i, crc),
 k AS MATERIALIZED (SELECT w, xor(arg_max(c, i), 4294967295) % 10000 AS bucket FROM hashed GROUP BY w),
 s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
 o AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw) AS s, (SELECT coalesce(sum(n), 0) FROM bw) AS t),
 g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.t, 0) + 1) * (o.s + 10000) AS DOUBLE) / CAST((coalesce(s.s, 0) + 1) * (o.t + 10000) AS DOUBLE))) AS BIGINT) AS gain
   FROM s FULL JOIN t USING (bucket), o),
 wg AS MATERIALIZED (SELECT w, gain FROM k JOIN g USING (bucket)),
 m AS (SELECT doc_id, sum(gain) AS total FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN wg USING (w) GROUP BY doc_id),
 x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(floor(total / len(w)), 0) AS BIGINT) AS weight,
   CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
 y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM z"""


def sharding_sql(tree=sharding.TREE) -> str:
    """Each level's greatest draw among the children of the node above; crc32 folds a text's bytes."""
    nodes = []
    for name, t in (("shard", tree), ("grown_shard", sharding.grown(tree))):
        n = 0
        for r, x in enumerate(t):
            nodes.append((name, "", f"{r}", sharding.total(x), "NULL"))
            for k, y in enumerate(x):
                nodes.append((name, f"{r}", f"{r}/{k}", sharding.total(y), "NULL"))
                for i, w in enumerate(y):
                    nodes.append((name, f"{r}/{k}", f"{r}/{k}/{i}", float(w), n + i))
                n += len(y)
    values = ", ".join(f"('{a}', '{b}', '{c}', {w}, {n})" for a, b, c, w, n in nodes)
    draw = f"ln((CAST('0x' || md5(key || ':' || path)[1:{sharding.DIGITS}] AS BIGINT) + 0.5) / {16**sharding.DIGITS}.0) / weight"
    level = lambda above, parent: f"SELECT key, tree, arg_max(path, {draw}) AS path, arg_max(shard, {draw}) AS shard FROM (SELECT key, n.* FROM {above} JOIN n ON {parent}) GROUP BY key, tree"
    return f"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
 n(tree, parent, path, weight, shard) AS (VALUES {values}),
 k AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
 r1 AS ({level("k", "n.parent = ''")}),
 r2 AS ({level("(SELECT key, tree AS of_tree, path AS node FROM r1)", "n.tree = of_tree AND n.parent = node")}),
 r3 AS ({level("(SELECT key, tree AS of_tree, path AS node FROM r2)", "n.tree = of_tree AND n.parent = node")}),
 h AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
 b AS (SELECT doc_id, key, CAST(len(h) // 2 + 8 AS BIGINT) AS size, {_BYTES} AS b FROM h),
 d AS (SELECT doc_id, key, size, CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(s.shard AS INT) AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(g.shard AS INT) AS grown_shard
FROM d JOIN r3 s ON s.key = d.key AND s.tree = 'shard' JOIN r3 g ON g.key = d.key AND g.tree = 'grown_shard'"""
