"""DuckDB SQL for the queries that SQL can express: plain joins of all rows."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = f"""
WITH RECURSIVE d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORDS}) AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = d.doc_id
"""

OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w
  FROM documents),
p AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
g AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
o AS (SELECT unnest(generate_series(0, 34)) AS o),
x AS (SELECT DISTINCT r, i + o AS j FROM h JOIN g USING (h) CROSS JOIN o),
t AS (SELECT r, unnest(generate_series(1, len(w))) AS j, unnest(w) AS word FROM d),
k AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n_kept
  FROM t ANTI JOIN x USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN k ON k.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms(source: str) -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return f"SELECT row_number() OVER () AS r, *, regexp_extract_all({lower}, {_TERMS}) AS t FROM {source}"


OP13 = f"""
WITH d AS ({_terms("documents")}),
i AS ({_terms("benchmark")}),
c AS (SELECT count(*) AS nn, sum(len(t)) AS ll FROM d WHERE len(t) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM f CROSS JOIN c GROUP BY term, nn),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * nn) // ll AS m FROM d CROSS JOIN c WHERE len(t) > 0),
q AS (SELECT DISTINCT r AS k, item_id, unnest(t) AS term FROM i),
s AS (
  SELECT k, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
