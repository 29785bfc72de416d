"""Query op7: repeated strings of 50 bytes removed."""

from gapweave.llm import repeats


def op7_repeats(spark, sf_dir):
    return repeats.removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_repeats": op7_repeats}
SQL = {"op7_repeats": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
first AS MATERIALIZED (SELECT s, min(doc_id) AS a FROM w GROUP BY 1 HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN first USING (s) WHERE doc_id > a),
spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR p > before + 1) AS s FROM (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
rest AS (SELECT x.doc_id, string_agg(byte, '' ORDER BY x.p) AS h FROM (
  SELECT doc_id, substr(h, 2 * p + 1, 2) AS byte, p FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM spans))) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(spans.n, 0)::BIGINT AS n_removed, coalesce(spans.s, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN spans.n IS NULL THEN d.h ELSE coalesce(rest.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN rest USING (doc_id)"""}
