"""SQL for the rows of the operators that SQL can express on whole tables."""

_REACHED = """
links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.id),
lowest AS (SELECT id, min(c) AS component_id FROM reached GROUP BY id)"""

VECTORS = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
found AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON id = vec_id"""

SHINGLES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
nodes AS (SELECT doc_id AS id FROM documents),
found AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN lowest ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 +
           ((CAST('0x' || substr(sha1(html), 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p"""

FILTERS = """
WITH w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (
    SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
           || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
d AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
      FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM l v, l w, l x, l y, l z
      WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, n, good, toxic, fails, substr(filter_order, step, 1) AS c,
             translate(substr(filter_order, 1, step - 1), fails, '') = substr(filter_order, 1, step - 1) AS there
      FROM d, o, unnest(range(1, 6)) AS t(step)),
t AS (SELECT *, contains(fails, c) AS bad FROM s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (there AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (there AND bad), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bad AND NOT there), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = c), 0)::BIGINT AS unique_fails,
       coalesce(sum(n) FILTER (there AND bad AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (there AND bad AND toxic), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (bad), 0)::BIGINT AS shapley
FROM t GROUP BY part, filter_order, step"""
