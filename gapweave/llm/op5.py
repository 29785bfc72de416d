"""Query op5: repeated three-line windows removed."""

from gapweave.llm import lines


def op5_line_dedup(spark, sf_dir):
    return lines.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {"op5_line_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, len(l) AS n, l[i:i + 2] AS win FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, 2))) AS i FROM d WHERE len(l) > 1 OR l[1] <> '')),
later AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, least(i + 3, n + 1))) AS p FROM later),
spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR p > before + 1) AS s FROM (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
kept AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.p) AS t FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(spans.n, 0)::BIGINT AS n_removed, coalesce(spans.s, 0)::BIGINT AS n_spans,
  sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""}
