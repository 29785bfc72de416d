"""Query op11: embeddings compressed to codes."""

from gapweave.llm import codes


def op11_vector_codes(spark, sf_dir):
    return codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Rounds written out: assign every part, then move the entries."""
    steps = []
    for r in range(codes.ROUNDS + 1):
        steps.append(f"""n{r} AS MATERIALIZED (SELECT k.row, k.part, b.entry, sum((x - b.c) * (x - b.c)) AS d FROM k JOIN b{r} b USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM n{r} GROUP BY ALL)""")
        if r < codes.ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(floor(m.s / m.n)::BIGINT, b.c) AS c FROM b{r} b LEFT JOIN (
  SELECT part, entry, pos, sum(x)::DOUBLE AS s, count(*) AS n FROM k JOIN a{r} USING (row, part) GROUP BY ALL) m USING (part, entry, pos))""")
    last = codes.ROUNDS
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT row, i // w AS part, i % w AS pos, v[i + 1] AS x FROM (SELECT row, v, len(v) // {codes.PARTS} AS w, unnest(range(0, len(v))) AS i FROM e)),
b0 AS MATERIALIZED (SELECT part, row AS entry, pos, x AS c FROM k WHERE row < {codes.ENTRIES}),
{", ".join(steps)},
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{last}) AS codebooks_sha256 FROM e JOIN codes USING (row)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
