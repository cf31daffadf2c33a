"""SQL (DuckDB) for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
            ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS g FROM w),
        e AS (SELECT doc_id, unnest(g) AS h FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
        o AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS m FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT p, q FROM o JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * m >= 75 * (a.n + b.n - m)),
        k AS (SELECT p AS u, q AS v FROM l UNION ALL SELECT q, p FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, k.v FROM r JOIN k ON k.u = r.other),
        c AS (SELECT doc_id, min(other) AS component_id, count(*) AS component_size FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, component_size FROM c JOIN n USING (doc_id)""",
    "op11_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
            ELSE list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))) END AS g FROM w),
        e AS (SELECT doc_id, unnest(g) AS h FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
        o AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS m FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT p, q FROM o JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * m >= 80 * (a.n + b.n - m)),
        k AS (SELECT p AS u, q AS v FROM l UNION ALL SELECT q, p FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, k.v FROM r JOIN k ON k.u = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM c JOIN n USING (doc_id)""",
    # The table of crc32 is built from its polynomial; letters beyond a-z have two bytes in UTF-8.
    "op12_spelling": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        x AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
        y AS (SELECT doc_id, run, count(*) AS times FROM x GROUP BY ALL),
        b AS (SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM y),
        h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, z: xor(crc[(xor(c, z) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, t),
        d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
        v AS (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON v.word = a.rest UNION SELECT v.word, v.n, a.word, a.n FROM cut a JOIN v ON v.word = a.rest),
        best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.other_n = most) END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
            FROM v LEFT JOIN best USING (word)),
        r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
        e AS (SELECT r.word, r.at AS root FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""",
}
