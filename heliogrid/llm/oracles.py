"""DuckDB SQL for the corpus queries that SQL can express."""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) AS class,
             ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
             CAST(2 * ssize AS DOUBLE) AS cap FROM s),
q AS (SELECT *, cap / w AS ratio, CAST(sum(ssize) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM q),
m AS (SELECT *, max(CASE WHEN ratio > lvl THEN lvl END) OVER () AS level FROM l),
t AS (SELECT source, ssize, class, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * w END AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.ssize, t.target, t.class,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 THEN (start + size / 2.0::DOUBLE) / target ELSE 0.0::DOUBLE END AS x FROM p)
SELECT doc_id, size, ssize AS source_size, target,
       round(CASE WHEN 2 * start + size <= 2 * target THEN least(1.0::DOUBLE, CASE class WHEN 0 THEN 2 * x / (sqrt(greatest(2.25::DOUBLE - 2 * x, 0.0::DOUBLE)) + 1.5::DOUBLE)
             WHEN 1 THEN x ELSE 2 * x / (sqrt(0.0625::DOUBLE + 3 * x) + 0.25::DOUBLE) END) END, 6) AS position,
       size * (CASE WHEN 2 * start + size <= 2 * target THEN 1 ELSE 0 END
             + CASE WHEN 2 * (start + ssize) + size <= 2 * target THEN 1 ELSE 0 END) AS taken
FROM f"""

OP3 = r"""
WITH c AS (
  SELECT page_id AS id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM c),
rules(rhost, rpath, what) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(what, length(rhost || rpath)) AS by_rule
      FROM (SELECT DISTINCT host, path FROM h) u JOIN rules ON (u.host = rhost OR suffix(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY host, path),
b0 AS (SELECT h.*, f.rule, f.by_rule,
              list_transform(list_filter(string_split(h.path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS s0
       FROM h LEFT JOIN f USING (host, path)),
b AS (SELECT * EXCLUDE (s0), CASE WHEN len(s0) > 12 THEN list_append(s0[1:12], '**') ELSE s0 END AS segs FROM b0),
e AS (SELECT host, i - 1 AS depth, segs[i] AS seg FROM (SELECT host, segs, unnest(range(1, len(segs) + 1)) AS i FROM b)),
n AS (SELECT host, depth, seg, count(*) AS n FROM e GROUP BY ALL),
o AS (SELECT host, list(depth || ':' || seg) AS often FROM
      (SELECT *, sum(n) OVER (PARTITION BY host, depth) AS total FROM n) WHERE n >= 20 AND n >= total * 0.02::DOUBLE GROUP BY host),
r AS (SELECT b.id, b.host, b.path, b.rule, b.by_rule,
             list_transform(b.segs, lambda x, i: CASE WHEN list_contains(coalesce(o.often, []), (i - 1) || ':' || x) THEN x ELSE '*' END) AS segs
      FROM b LEFT JOIN o USING (host)),
rt AS (SELECT *, '/' || coalesce(array_to_string(segs, '/'), '') AS template FROM r),
t AS (SELECT host, template, segs, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked FROM rt GROUP BY ALL),
paths AS (SELECT host, template, tree, labelled, blocked, d AS depth, '/' || coalesce(array_to_string(segs[1:d], '/'), '') AS node FROM
          (SELECT *, unnest(range(0, len(segs) + 1)) AS d FROM (SELECT *, unnest([host, '*']) AS tree FROM t))),
nodes AS (SELECT tree, depth, node, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(blocked) AS BIGINT) AS blocked FROM paths GROUP BY ALL),
child AS (SELECT *, CASE WHEN depth = 0 THEN '*' ELSE tree END AS ut, greatest(depth - 1, 0) AS ud,
                 CASE WHEN depth <= 1 THEN '/' ELSE array_to_string(string_split(node, '/')[1:depth], '/') END AS un FROM nodes),
j AS (SELECT c.*, CASE WHEN p.labelled > 0 THEN p.blocked::DOUBLE / p.labelled ELSE 0.0::DOUBLE END AS p
      FROM child c JOIN nodes p ON c.ut = p.tree AND c.ud = p.depth AND c.un = p.node),
g AS (SELECT CASE WHEN labelled > 0 THEN blocked::DOUBLE / labelled ELSE 0.0::DOUBLE END AS overall FROM nodes WHERE tree = '*' AND depth = 0),
own AS (SELECT j.tree, j.depth, j.node, (j.blocked + 10.0::DOUBLE * g.overall) / (j.labelled + 10.0::DOUBLE) AS purity FROM j, g
        WHERE (j.tree = '*' AND j.depth = 0) OR (j.labelled > 0 AND pow(j.blocked - j.labelled * j.p, 2.0::DOUBLE) > 3.84::DOUBLE * j.labelled * j.p * (1 - j.p))),
v AS (SELECT host, template, max_by(purity, (CASE WHEN tree <> '*' THEN 1 ELSE 0 END) * 1000 + depth) AS purity FROM paths JOIN own USING (tree, depth, node) GROUP BY host, template)
SELECT rt.id AS page_id, rt.host, rt.path, rt.rule,
       coalesce(rt.by_rule, CASE WHEN v.purity >= 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, rt.template, v.purity
FROM rt LEFT JOIN v USING (host, template)"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, u.b FROM reach r JOIN u ON r.c = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.c) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY ALL"""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT CAST(sum(len(ws)) AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
g AS (SELECT doc_id, n_words, i, ws[i] AS w1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS w2,
             CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3 FROM p),
c AS (SELECT doc_id, n_words, i,
        count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY w1, doc_id) AS c1,
        CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, doc_id) END AS c2,
        CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) END AS c3 FROM g),
v AS (SELECT *, lag(c1, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS v1, lag(c2, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS v2 FROM c),
s AS (SELECT v.doc_id, c1, c2, c3,
        CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / v2) WHEN c2 > 0 THEN ln(0.4::DOUBLE * c2 / v1)
             WHEN c1 > 0 THEN ln(0.4::DOUBLE * 0.4::DOUBLE * c1 / (t.n - n_words)) ELSE ln(0.4::DOUBLE * 0.4::DOUBLE / (t.n - n_words + 1.0::DOUBLE)) END AS x
      FROM v, t),
r AS (SELECT doc_id, sum(x) AS x, count(*) FILTER (c3 > 0) AS n3, count(*) FILTER (c3 <= 0 AND c2 > 0) AS n2, count(*) FILTER (c3 <= 0 AND c2 <= 0 AND c1 > 0) AS n1 FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(x, 0.0::DOUBLE), 6) AS log_score, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram
FROM d LEFT JOIN r USING (doc_id)"""

OP2 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9::DOUBLE),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON r.c = l.a),
c AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a"""

OP7 = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM k"""

ORACLE_SQL = {"op7_warc": OP7, "op1_lm_scoring": OP1, "op2_embedding_near_dedup": OP2, "op4_ngram_jaccard": OP4, "op3_url_filter": OP3, "op8_mixing": OP8}
