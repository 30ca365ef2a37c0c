"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(whole) AS text_sha256
FROM t WINDOW same AS (PARTITION BY whole)"""

# Base 32: each group of five hexadecimal digits of SHA-1 holds four letters.
OP10 = """
WITH t AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
p AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS winner FROM t),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS five
      FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           ((five[CAST(j // 4 + 1 AS INT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM g"""

OP6 = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM t WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS start, doc_id AS node FROM documents
      UNION SELECT r.start, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT start AS doc_id, min(node) AS component_id FROM r GROUP BY start)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ') + length(shown) + length(' </turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP11 = """
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
-- Unsigned crc32 of the decimal id, bit by bit.
h AS (SELECT conv_id, n, conv_id - conv_id % 100 AS base, (xor(4294967295, list_reduce(
          list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
              lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))) % 6 AS h
      FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
c AS (SELECT a.conv_id, a.n, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM h a LEFT JOIN h b ON b.conv_id = a.base),
r AS (SELECT c.conv_id, t.pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, taken + t.pos - h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
p AS (SELECT conv_id, depth, length(text) AS chars,
             string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY depth) OVER w AS path,
             count(*) OVER (PARTITION BY conv_id) AS len FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, depth, chars, sha256(path) AS key, coalesce(lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth),
             'root') AS parent, len FROM p
      UNION ALL SELECT c.conv_id, 0, 0, 'root', NULL, taken + greatest(n - h, 0) FROM c),
n AS (SELECT key, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs,
             (count(*) - 1) * min(chars) AS own,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
      FROM m GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n GROUP BY parent),
u AS (SELECT key AS top, key FROM n UNION ALL SELECT u.top, n.key FROM u JOIN n ON n.parent = u.key),
s AS (SELECT top AS key, count(*) FILTER (k.key IS NULL) AS n_leaves, CAST(sum(n.own) AS BIGINT) AS saved_tokens
      FROM u JOIN n ON n.key = u.key LEFT JOIN k ON k.key = u.key GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n q ON q.key = n.parent"""

FINITE = """embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"""


def _op13() -> str:
    """Six rounds written out: assignments a0 to a6, codebooks c0 to c6."""
    s = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {FINITE}),
x AS MATERIALIZED (SELECT r, vec_id, p, v[CAST(p * len(v) // 8 + 1 AS INT):CAST((p + 1) * len(v) // 8 AS INT)] AS v FROM k, range(8) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS e, v FROM x QUALIFY e < 16)"""
    for i in range(7):
        s += f""",
a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT r, x.p, e, CAST(list_sum(list_transform(
        list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{i} c ON x.p = c.p) GROUP BY r, p)"""
        if i < 6:
            s += f""",
s{i} AS (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT x.p, a.e, x.v, unnest(range(1, len(x.v) + 1)) AS i
        FROM x JOIN a{i} a USING (r, p)) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(any_value(m.v), any_value(c.v)) AS v FROM c{i} c LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e
        GROUP BY c.p, c.e)"""
    s += """,
f AS (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c6) AS codebooks_sha256
FROM f JOIN k USING (r)"""
    return s


ORACLES: dict[str, str] = {"op6_near_dedup": OP6, "op7_topk": OP7, "op9_chat": OP9, "op4_exact_dedup": OP4, "op10_warc": OP10,
                           "op11_prefix_trie": OP11, "op13_vector_codes": _op13()}
