"""DuckDB SQL for the numbered queries that SQL can express; tests hold the others to brute force."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op5_exact_topk": """
        WITH rows AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM (SELECT DISTINCT * FROM rows) q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_blocked_search": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), docs AS (
            SELECT r, doc_id, t, len(t) AS n FROM texts WHERE len(t) > 0
        ), totals AS (
            SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
        ), lengths AS (
            SELECT r, doc_id, CAST(100 - 50 + ((50 * n * docs) // terms) AS BIGINT) AS m FROM docs, totals
        ), wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), held AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs)
            WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
        ), scored AS (
            SELECT q.item_id, l.doc_id, l.r,
                   CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * l.m))) AS BIGINT) AS score
            FROM wanted q JOIN held h USING (term) JOIN weights w USING (term) JOIN lengths l ON l.r = h.r
            GROUP BY q.item_id, l.doc_id, l.r
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
    "op12_decontamination": r"""
        WITH passages AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item, len(w[i:i + 9]) AS size, array_to_string(w[i:i + 9], ' ') AS passage
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM passages WHERE len(w) > 0)
        ), docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents
        ), places AS (
            SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs
        ), found AS (
            SELECT p.r, p.i, p.i + s.size - 1 AS e, x.item
            FROM places p CROSS JOIN (SELECT DISTINCT size FROM windows) s
            JOIN windows x ON x.size = s.size AND x.passage = array_to_string(p.w[p.i:p.i + s.size - 1], ' ')
            WHERE p.i + s.size - 1 <= len(p.w)
        ), hits AS (
            SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(i, e + 1)) AS i FROM found) GROUP BY r
        ), named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
               h.r IS NOT NULL AS contaminated
        FROM docs d LEFT JOIN hits h USING (r) LEFT JOIN named n USING (r)
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id AS c,
                   list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), heads AS (
            SELECT c, l, xor(list_reduce(
                list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                lambda v, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda u, k: xor(u >> 1, (u & 1) * 3988292384), xor(v, b)),
                CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h
            FROM own
        ), rebuilt AS (
            SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
            FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100
        ), members AS (
            SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt
        ), nodes AS (
            SELECT d, l[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs,
                   string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(l) = d) AS ends
            FROM members GROUP BY d, l[1:d]
        ), numbered AS (
            SELECT *, row_number() OVER () AS id,
                   (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS own_saved FROM nodes
        ), links AS (
            SELECT k.id AS child, u.id AS parent, u.conv_id AS parent_conv_id
            FROM numbered k JOIN numbered u ON k.d = u.d + 1 AND k.p[1:u.d] = u.p
        ), children AS (
            SELECT parent AS id, count(*) AS n FROM links GROUP BY parent
        ), below AS (
            SELECT u.id, sum(k.own_saved) AS saved, count(*) FILTER (WHERE k.id NOT IN (SELECT id FROM children)) AS leaves
            FROM (SELECT id, d, p, own_saved, unnest(range(0, d + 1)) AS ud FROM numbered) k
            JOIN numbered u ON u.d = k.ud AND k.p[1:k.ud] = u.p
            GROUP BY u.id
        )
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, l.parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM numbered n LEFT JOIN links l ON l.child = n.id LEFT JOIN children c ON c.id = n.id JOIN below b ON b.id = n.id
    """,
}
