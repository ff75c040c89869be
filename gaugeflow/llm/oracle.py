"""SQL the operators' queries are checked against."""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::BIGINT AS part
  FROM documents),
binned AS (
  SELECT *, CASE WHEN size < 64 THEN size
                 ELSE 32 * length(bin(size)) + floor(size / pow(2.0, length(bin(size)) - 6))::BIGINT END AS b
  FROM sized),
sums AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM binned GROUP BY skey, source),
weighted AS (
  SELECT skey, source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM sums),
placed AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest
  FROM weighted WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
levels AS (SELECT *, (total - filled) / rest AS lev FROM placed),
firsts AS (SELECT *, min(CASE WHEN lev * w <= cap THEN place END) OVER () AS fp FROM levels),
chosen AS (SELECT *, max(CASE WHEN place = fp THEN lev END) OVER () AS lam FROM firsts),
targets AS (
  SELECT skey, source_size, CASE WHEN fp IS NULL OR place < fp THEN cap ELSE lam * w END AS target FROM chosen),
ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         (row_number() OVER (PARTITION BY d.skey ORDER BY d.b, d.part, d.size, d.doc_id) - 1)::DOUBLE AS rk,
         ('0x' || substr(md5('mix:' || d.skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r
  FROM binned d JOIN targets t USING (skey))
SELECT doc_id, size, source_size, target,
       ((floor(u + r * (rk + 1)) - floor(u + r * rk))::BIGINT * size)::BIGINT AS taken
FROM ranked
"""


OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
cand AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM cand JOIN wins USING (n, win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit
           FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""


OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents),
long AS (SELECT * FROM lines WHERE length(line) >= 20),
firsts AS (
  SELECT line, doc_id, place, length(line) AS n, row_number() OVER (ORDER BY doc_id, place) AS rk
  FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS o FROM long) WHERE o = 1),
near AS (
  SELECT DISTINCT a.line FROM (SELECT *, unnest([n - 1, n, n + 1]) AS m FROM firsts) a JOIN firsts b
  ON b.n = a.m AND b.rk < a.rk
  AND CASE WHEN left(a.line, 8) = left(b.line, 8) OR right(a.line, 8) = right(b.line, 8)
           THEN levenshtein(a.line, b.line) <= 1 ELSE false END),
short AS (
  SELECT doc_id, place FROM (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS o FROM lines
    WHERE length(line) < 20 AND regexp_matches(line, '[^ \t\n\x0B\f\r]')) WHERE o = 1),
kept AS (
  SELECT doc_id, place FROM firsts WHERE line NOT IN (SELECT line FROM near)
  UNION ALL SELECT doc_id, place FROM short
  UNION ALL SELECT doc_id, place FROM lines WHERE length(line) < 20 AND NOT regexp_matches(line, '[^ \t\n\x0B\f\r]')),
texts AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY place) AS t
  FROM kept JOIN lines USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(n_kept, 0)::BIGINT AS n_kept, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""

#: Pages without links between them, as those of the tables, have no aliases.
OP9 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
rules(action, h, pre) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, h || pre AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS o
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fit WHERE o = 1) f USING (page_id)
"""


OP7 = r"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, url AS target_uri
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2,
        "op4_decontamination": OP4,
        "op5_ngram_join": OP5,
        "op7_warc": OP7,
        "op9_url_filters": OP9,
        "op10_mixing": OP10,
    }
