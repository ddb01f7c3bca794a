"""DuckDB SQL for the queries that SQL can express.

Learned scores (op3), sampling by XXH64 keys (op2), mined rules (op5), XXH64
fingerprints (op8) and tokenizers (op10) have none; tests hold those against brute force.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"

OP1 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p,
   unnest(list_transform(range(1, len(ws) + 1), lambda s: CASE WHEN s + 49 <= len(ws) THEN md5(array_to_string(ws[s:s + 49], ' ')) END)) AS win FROM w),
 m AS (SELECT *, (win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win))::INT AS hit FROM p),
 c AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m)
 SELECT w.doc_id, any_value(len(ws))::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256
 FROM w LEFT JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id"""

OP4 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 p AS (SELECT doc_id, unnest(ws) AS w0, unnest(range(1, len(ws) + 1)) AS p FROM w),
 g AS (SELECT *, lag(w0) OVER d AS w1, lag(w0, 2) OVER d AS w2 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
 c AS (SELECT *, count(*) OVER (PARTITION BY w0) AS c1, count(*) OVER (PARTITION BY w1, w0) AS c2, count(*) OVER (PARTITION BY w2, w1, w0) AS c3, count(*) OVER () AS n FROM g),
 x AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
 s AS (SELECT doc_id, CASE WHEN w2 IS NOT NULL AND c3 >= 2 THEN ln(c3) - ln(b2)
   ELSE (CASE WHEN w2 IS NOT NULL THEN ln(0.4) ELSE 0 END) + CASE WHEN w1 IS NOT NULL AND c2 >= 2 THEN ln(c2) - ln(b1)
     ELSE (CASE WHEN w1 IS NOT NULL THEN ln(0.4) ELSE 0 END) + ln(c1 / n) END END AS s FROM x)
 SELECT w.doc_id, count(s)::BIGINT AS n_tokens, round(coalesce(sum(s), 0), 6) AS log_score, round(avg(s), 6) AS mean_log_score FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id"""

OP6 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b),
 k AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
 SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN k ON k.a = v.vec_id"""

OP7 = r"""WITH sh AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\v\f\r]+') AS ws FROM documents
   UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\v\f\r]+') FROM benchmark),
 u AS (SELECT kind, id, len(ws) - 4 AS n, unnest(range(0, len(ws) - 4)) AS p, unnest(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) AS h FROM sh WHERE len(ws) >= 5),
 d AS (SELECT * FROM u WHERE kind = 'd'), i AS (SELECT id AS item_id, n AS m, h, count(*) AS k FROM u WHERE kind = 'i' GROUP BY ALL),
 hits AS (SELECT DISTINCT d.id AS doc_id, d.n, d.p, item_id, m, least(m, d.n) AS w FROM d JOIN i USING (h)),
 starts AS (SELECT DISTINCT doc_id, item_id, m, w, unnest(range(greatest(p - w + 1, 0), least(p, n - w) + 1)) AS s FROM hits),
 bags AS (SELECT starts.*, d.h, count(*) AS k FROM starts JOIN d ON d.id = doc_id AND d.p >= s AND d.p < s + w GROUP BY ALL),
 sims AS (SELECT doc_id, b.item_id, s, sum(least(b.k, i.k)) / (any_value(w) + any_value(b.m) - sum(least(b.k, i.k))) AS similarity FROM bags b JOIN i ON i.item_id = b.item_id AND i.h = b.h GROUP BY ALL)
 SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, arg_max(s, (similarity, -s))::INT AS start FROM sims WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

OP9 = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
 p AS (SELECT doc_id, unnest(range(0, octet_length(x))) AS p, unnest(list_transform(range(1, octet_length(x) + 1), lambda s: hex(x[s:s]))) AS byte,
   unnest(list_transform(range(1, octet_length(x) + 1), lambda s: CASE WHEN s + 199 <= octet_length(x) THEN md5(x[s:s + 199]) END)) AS win FROM t),
 m AS (SELECT *, (win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1)::INT AS hit FROM p),
 c AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM m),
 e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS opens FROM c)
 SELECT t.doc_id, any_value(octet_length(x))::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_spans,
   sha256(unhex(coalesce(string_agg(byte, '' ORDER BY p) FILTER (gone = 0), ''))) AS kept_sha256 FROM t LEFT JOIN e ON e.doc_id = t.doc_id GROUP BY t.doc_id"""
