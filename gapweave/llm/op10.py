"""Query op10: groups of near copies."""

from gapweave.llm import nearcopies


def op10_near_copies(spark, sf_dir):
    return nearcopies.near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_near_copies": op10_near_copies}
SQL = {"op10_near_copies": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS gram FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.id AS component_id, d.doc_id = c.id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS id FROM reach GROUP BY 1) c ON c.a = d.doc_id"""}
