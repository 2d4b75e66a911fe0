"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_exact_top_k": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(t ORDER BY pos) AS ts,
                   -- crc32 of the decimal id, bit by bit
                   xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
                       list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                       lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)),
                           lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 4 AS h
            FROM turns GROUP BY conv_id
        ), rebuilt AS (
            SELECT o.conv_id, list_concat(coalesce(list_slice(d.ts, 1, o.h), []), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts
            FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 20
        ), path AS (
            SELECT conv_id, d AS depth, list_slice(ts, 1, d) AS prefix, list_slice(ts, 1, d - 1) AS parent, d = len(ts) AS last,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(ts[d].text, '[^\x20\x09-\x0D]+')) END AS words
            FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
        ), node AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs,
                   (count(*) - 1) * any_value(words) AS saved, count(*) FILTER (last) AS ends,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
            FROM path GROUP BY depth, prefix
        ), child AS (
            SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
        ), told AS (
            SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (depth, prefix)
        ), below AS (
            -- the path of a node's smallest member holds all its ancestors
            SELECT p.depth, p.prefix, sum(t.saved) AS saved_tokens, count(*) FILTER (t.n_children = 0) AS n_leaves
            FROM told t JOIN path p ON p.conv_id = t.conv_id AND p.depth <= t.depth GROUP BY p.depth, p.prefix
        )
        SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, b.n_leaves,
               CAST(b.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
        FROM told t JOIN below b ON t.depth = b.depth AND t.prefix = b.prefix
        LEFT JOIN node u ON t.depth > 0 AND u.depth = t.depth - 1 AND u.prefix = t.parent
    """,
    "op13_hard_negatives": """
        WITH vectors AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, a.v AS anchor, c.vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score
            FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
            WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
}
